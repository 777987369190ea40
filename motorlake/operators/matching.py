"""Linking listings to canonical models, filling what models lack, and classes written back only where they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlake.functions.semantics import distinct_from, half_even_int
from motorlake.functions.text import norm_fuel, norm_gearbox, norm_key, norm_make, norm_model

#: What a canonical model may lack.
SPECS = ("cc", "co2", "power_hp")


#: What the keys of a listing are read from.
RAW = ["make_raw", "model_raw", "fuel_raw", "variant", "co2"]


def alike(listings: DataFrame) -> DataFrame:
    """(RAW, times): what listings say of make, model and fuel, and how many say just that; keys then cost once for each."""
    return listings.groupBy(*RAW).agg(F.count("*").alias("times"))


def keyed(listings: DataFrame) -> DataFrame:
    """``listings`` (make_raw, model_raw, fuel_raw, variant, co2, ...) with make_key, model_key, fuel_key and norm_key; norm_key is null where one of the three is."""
    make = norm_make(F.col("make_raw"))
    named = listings.withColumns({"make_key": make, "model_key": norm_model(make, F.col("model_raw"), F.col("variant")), "fuel_key": norm_fuel(F.col("fuel_raw"), F.col("variant"), F.col("co2"))})
    return named.withColumn("norm_key", norm_key(F.col("make_key"), F.col("model_key"), F.col("fuel_key")))


def upserted_models(keyed_listings: DataFrame, models: DataFrame) -> DataFrame:
    """Canonical models (norm_key, make, model, fuel, listings, is_new) after the links: all of ``models`` (norm_key, make, model, fuel), and one for each new key. Listings that are alike() count ``times``."""
    times = F.sum("times") if "times" in keyed_listings.columns else F.count("*")
    found = keyed_listings.where("norm_key is not null").groupBy("norm_key").agg(F.min("make_key").alias("_make"), F.min("model_key").alias("_model"), F.min("fuel_key").alias("_fuel"), times.alias("listings"))
    joined = models.withColumn("_held", F.lit(True)).join(found, "norm_key", "full_outer")
    known = lambda c: F.when(F.col("_held"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return joined.select("norm_key", known("make"), known("model"), known("fuel"), F.coalesce("listings", F.lit(0).cast("bigint")).alias("listings"), F.col("_held").isNull().alias("is_new"))


def filled_models(models: DataFrame, listings: DataFrame) -> DataFrame:
    """``models`` (model_id, SPECS, ...) where what is missing is the median of the model's listings that are alive; known values stay. Only the listings of models that lack something are read into the medians."""
    lacking = models.where(" or ".join(f"{c} is null" for c in SPECS)).select("model_id")
    medians = listings.where("model_id is not null and deleted_at is null").join(lacking, "model_id", "left_semi").groupBy("model_id").agg(*[half_even_int(F.percentile(c, F.lit(0.5))).alias(f"_{c}") for c in SPECS])
    return models.join(medians, "model_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in SPECS}).drop(*[f"_{c}" for c in SPECS])


def gearbox_writes(listings: DataFrame) -> DataFrame:
    """(id, gearbox_norm): the classes to write for ``listings`` (id, gearbox, gearbox_norm, deleted_at) that are alive and have another one now; a second run has none."""
    now = norm_gearbox(F.col("gearbox"))
    return listings.where("deleted_at is null").withColumn("_now", now).where(distinct_from(F.col("_now"), F.col("gearbox_norm"))).select("id", F.col("_now").alias("gearbox_norm"))
