"""The identity of a physical vehicle across listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorlake.functions.semantics import capture

#: Fixed value: a vehicle identification number as a part of a URL.
VIN_IN_URL = "(?:^|[/-])([A-HJ-NPR-Za-hj-npr-z0-9]{17})(?:[/-]|$)"


def fallback_identity(model_id: Column, year: Column, km: Column, price: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.concat(model_id.cast("string"), F.lit(":"), text(year), F.lit(":"), F.round(F.coalesce(km, F.lit(0)), -3).cast("bigint").cast("string"), F.lit(":"), text(price))


def car_identity(vin: Column, url: Column, model_id: Column, year: Column, km: Column, price: Column) -> Column:
    """The VIN, else one in the URL, else model, year, rounded kilometres and price."""
    return F.coalesce(F.upper(vin), F.upper(capture(url, VIN_IN_URL)), fallback_identity(model_id, year, km, price))
