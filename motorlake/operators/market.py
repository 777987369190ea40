"""Home-market samples, origin plausibility and verdicts.

A sample is the same for all listings with the same sampling key (model, year, band of
kilometres, power), so statistics are computed once for each key and joined back; the
guard on kilometres needs the listing itself and comes after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from motorlake.functions import tax
from motorlake.functions.identity import fallback_identity
from motorlake.functions.semantics import half_even_int, half_up

KEY = ["model_id", "year", "km_band", "power_hp"]
#: What may narrow a sample further: the years of a generation, and the family and derivative that a listing is known to be of.
LIMITS = ["gen_start", "gen_end", "family", "derivative"]
#: Days that an observation counts.
WINDOW_DAYS = 60


@dataclass(frozen=True)
class Guards:
    """What a sample must have."""

    least: int = 5
    least_wide: int = 3
    prices: int = 3
    sellers: int = 2
    spread: float = 0.25
    wide_range: float = 0.30
    km_ratio: float = 1.6
    km_floor: int = 1000
    origin_ratio: float = 0.5
    origin_least: int = 5


GUARDS = Guards()


def km_band(km: Column) -> Column:
    return F.floor(km / 25000).cast("int")


def power_tolerance(power: Column) -> Column:
    return F.greatest(half_up(power * 0.1), F.lit(15))


def probes(listings: DataFrame, home: str = "PT") -> DataFrame:
    """Foreign listings that can be judged."""
    rows = listings.where((F.col("country") != home) & (F.col("km") > 6000) & (F.col("price") > 0))
    return rows.withColumn("km_band", km_band(F.col("km")))


def observations(listings: DataFrame, home: str = "PT", since: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Home prices with hashes of the vehicle's identity and of the seller; ``since`` leaves older ones out, ``also`` names columns to carry."""
    rows = listings.where((F.col("country") == home) & F.col("power_hp").isNotNull())
    if since is not None:
        rows = rows.where(F.col("observed_at") > since)
    return rows.select("id", "model_id", "year", "km", km_band(F.col("km")).alias("km_band"), "price", "power_hp", F.xxhash64(F.coalesce("seller", "id")).alias("seller"), "observed_at", F.xxhash64(fallback_identity(F.col("model_id"), F.col("year"), F.col("km"), F.col("price"))).alias("identity"), *also)


#: What a sample has, within one band and within two (prefix w_).
STATISTICS = ["n", "median", "p25", "p75", "median_km", "min", "max", "prices", "sellers"]


def _half_even_quantile(values: np.ndarray, q: float) -> int | None:
    """As half_even_int(percentile()) of sorted values."""
    if not len(values):
        return None
    place = (len(values) - 1) * q
    low, high = int(np.floor(place)), int(np.ceil(place))
    return int(np.rint(values[low] if low == high else (high - place) * float(values[low]) + (place - low) * float(values[high])))


def _samples_of_cell(key: list[str], names: list[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The task's part of sample_statistics(): the keys of one model and year, and the vehicles of three years."""

    def samples(asked: pa.Table, seen: pa.Table) -> pa.Table:
        if not asked.num_rows or not seen.num_rows:
            return schema.empty_table()
        column = lambda c: seen.column(c).combine_chunks()
        values = {c: column(f"o_{c}").unique().drop_null() for c in names}
        codes = {c: {v: i for i, v in enumerate(values[c].to_pylist())} for c in names}
        coded = [pc.fill_null(pc.index_in(column(f"o_{c}"), values[c]), -1).to_numpy() for c in names]
        order = np.lexsort([column("turn").to_numpy(), column("identity").to_numpy(), column("price").to_numpy(zero_copy_only=False)])
        taken = lambda v: v[order]
        price, km = (taken(column(c).to_numpy(zero_copy_only=False)) for c in ("price", "km"))
        vehicle, seller = taken(column("identity").to_numpy()), taken(np.unique(column("seller").to_numpy(), return_inverse=True)[1])
        # rows alike in all that keys ask of them are let in or left out together
        traits = np.stack([column(c).to_numpy() for c in ("o_year", "o_band", "o_power")] + coded, 1)
        kinds, kind = np.unique(traits, axis=0, return_inverse=True)
        kind, (year, band, power), others = taken(kind.reshape(-1)), kinds.T[:3], dict(zip(names, kinds.T[3:]))
        known: dict[bytes, list] = {}

        def statistics(kept: np.ndarray) -> list:
            at = np.flatnonzero(kept[kind])
            at = at[np.diff(vehicle[at], prepend=vehicle[at[0]] + 1) != 0] if len(at) else at
            prices, kms = price[at], np.sort(km[at])
            prices = prices[~np.isnan(prices)] if prices.dtype.kind == "f" else prices
            ends = [prices[0].item(), prices[-1].item()] if len(prices) else [None, None]
            quantiles = [_half_even_quantile(prices, q) for q in (0.5, 0.25, 0.75)]
            return [len(prices), *quantiles, _half_even_quantile(kms, 0.5), *ends, int(np.count_nonzero(np.diff(prices)) + 1) if len(prices) else 0, int(np.count_nonzero(np.bincount(seller[at])))]

        def of(kept: np.ndarray) -> list:
            mark = kept.tobytes()
            if mark not in known:
                known[mark] = statistics(kept)
            return known[mark]

        found: list[list] = []
        for row in asked.select(key).to_pylist():
            kept = (np.abs(band - row["km_band"]) <= 2) & (np.abs(power - row["power_hp"]) <= max(np.floor(row["power_hp"] * 0.1 + 0.5), 15))
            if row.get("gen_start") is not None:
                kept &= year >= row["gen_start"]
            if row.get("gen_end") is not None:
                kept &= year <= row["gen_end"]
            if row.get("family") is not None and row.get("derivative") is not None:
                same, body = codes["family"].get(row["family"], -2), codes["derivative"].get(row["derivative"], -2)
                kept &= ~((others["family"] == same) & (others["derivative"] != body) & (others["derivative"] >= 0))
            if kept.any():
                found.append([*row.values(), *of(kept & (np.abs(band - row["km_band"]) <= 1)), *of(kept)])
        return pa.table([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    return samples


def sample_statistics(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """Statistics of the samples of each key, within one band and within two (prefix w_).

    Keys may have any of LIMITS besides KEY. Years outside a generation's window don't
    count; nor do observations that are known (family and derivative of ``seen``) to be of
    the key's family but of another derivative. What isn't known never excludes. Of one
    vehicle's observations the latest in the sample counts; ties go to the largest id.

    Observations are first reduced to the latest of each vehicle, band, power, family and
    derivative. These are dealt out to the three years whose keys can look at
    them, and meet the keys of one there: in order of price, so that a sample is a
    selection of them that no pair of key and observation is written down for.
    """
    key = [*KEY, *(c for c in LIMITS if c in keys.columns)]
    names = ["family", "derivative"] if {"family", "derivative"} <= set(key) else []
    vehicle = ["model_id", "year", "identity", "price"]
    latest = seen.where("km_band is not null and power_hp is not null").groupBy(*vehicle, "km_band", "power_hp", *names).agg(F.max(F.struct("observed_at", "id", "seller", "km")).alias("last"))
    turn = F.row_number().over(Window.partitionBy("model_id", "year", "identity").orderBy(F.col("last.observed_at").desc(), F.col("last.id").desc()))
    placed = latest.select(F.col("model_id").alias("o_model"), F.col("year").alias("o_year"), "identity", "price", F.col("km_band").alias("o_band"), F.col("power_hp").alias("o_power"), *(F.col(c).alias(f"o_{c}") for c in names), "last.seller", "last.km", turn.alias("turn"))
    spread = placed.select("*", F.explode(F.sequence(F.col("o_year") - 1, F.col("o_year") + 1)).alias("see_year"))
    asked = keys.where("model_id is not null and year is not null and km_band is not null and power_hp is not null").select(*key)
    kinds, prices = {f.name: f.dataType for f in keys.select(*key).schema}, seen.schema["price"].dataType
    figures = {"n": LongType(), "min": prices, "max": prices}
    schema = StructType([StructField(c, kinds[c]) for c in key] + [StructField(p + c, figures.get(c, IntegerType())) for p in ("", "w_") for c in STATISTICS])
    return asked.groupBy("model_id", "year").cogroup(spread.groupBy("o_model", "see_year")).applyInArrow(_samples_of_cell(key, names, to_arrow_schema(schema)), schema)


def _coherent(prefix: str, least: int, km: Column, g: Guards) -> Column:
    c = lambda name: F.col(prefix + name)
    return (c("n") >= least) & (c("prices") >= g.prices) & (c("sellers") >= g.sellers) & ((c("p75") - c("p25")) / c("median") <= g.spread) & ((km + g.km_floor) / (c("median_km") + g.km_floor) <= g.km_ratio)


def home_prices(rows: DataFrame, seen: DataFrame, guards: Guards = GUARDS) -> DataFrame:
    """``rows`` with home_price, sample_size, confidence (normal, alargada or null) and the statistics of both samples."""
    key = [*KEY, *(c for c in LIMITS if c in rows.columns)]
    statistics = sample_statistics(rows.select(*key).distinct(), seen)
    renamed = statistics.withColumnsRenamed({c: f"s_{c}" for c in key})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in key])
    joined = rows.join(renamed, same, "left").drop(*[f"s_{c}" for c in key])
    normal = F.coalesce(_coherent("", guards.least, F.col("km"), guards), F.lit(False))
    wide = F.coalesce(_coherent("w_", guards.least_wide, F.col("km"), guards) & ((F.col("w_max") - F.col("w_min")) / F.col("w_median") <= guards.wide_range), F.lit(False))
    return joined.withColumns({"confidence": F.when(normal, "normal").when(wide, "alargada"), "home_price": F.when(normal, F.col("median")).when(wide, F.col("w_median")), "sample_size": F.when(normal, F.col("n")).when(wide, F.col("w_n"))})


def costed(rows: DataFrame, reference_year: float = 2026.5, tables: tax.TaxTables = tax.TABLES_2026) -> DataFrame:
    """Adds the taxes, total_home, savings, savings_pct and verdict to rows with a home_price."""
    age = F.lit(reference_year) - F.col("year")
    parts = tax.registration_tax(F.col("fuel"), F.col("cc"), F.col("co2"), F.col("year"), age, tables)
    out = rows.withColumns(parts | {"iuc": tax.annual_tax(F.col("fuel"), F.col("cc"), F.col("co2"), F.col("year"), tables)})
    out = out.withColumn("total_home", tax.landed_cost(F.col("price"), F.col("country"), F.col("isv"), F.col("iuc")))
    out = out.withColumn("savings", F.col("home_price") - F.col("total_home"))
    out = out.withColumn("savings_pct", tax.savings_pct(F.col("savings"), F.col("home_price")))
    return out.withColumn("verdict", tax.verdict(F.col("savings_pct")))


#: Kilometres of a sample lie between these shares of the listing's.
ORIGIN_KM = (0.6, 1.6)
ORIGIN_CELL = ["model_id", "country", "year"]
ORIGIN_KEY = [*ORIGIN_CELL, "km", "power_hp"]


def _origin_of_cell(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The task's part of origin_samples(): the rows of one model, country and year, and the vehicles of three years."""

    def sampled(rows: pa.Table, market: pa.Table) -> pa.Table:
        def column(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

        size, medians = np.zeros(rows.num_rows, np.int64), np.full(rows.num_rows, np.nan)
        if market.num_rows:
            hashes, own = column(market, "o_vehicle"), column(rows, "o_vehicle")
            order = np.lexsort([hashes, column(market, "o_price")])
            price, hashes, listed = column(market, "o_price")[order], hashes[order], column(market, "o_n")[order]
            # vehicles are numbered by price, and rows have the number of their own
            change = np.diff(hashes, prepend=hashes[0] + 1) != 0
            vehicle = np.cumsum(change) - 1
            by_hash = np.argsort(hashes[change])
            place = np.minimum(np.searchsorted(hashes[change][by_hash], own), len(by_hash) - 1)
            own = np.where(hashes[change][by_hash][place] == own, by_hash[place], -1)
            kinds, kind = np.unique(np.stack([column(market, "o_km"), column(market, "o_power")], 1), axis=0, return_inverse=True)
            kind = kind.reshape(-1)[order]
            asked = np.stack([column(rows, c).astype(float) for c in ("km", "power_hp", "price")], 1)
            known = np.flatnonzero(~np.isnan(asked[:, :2]).any(1))
            keys, key = np.unique(asked[known, :2], axis=0, return_inverse=True)
            for rows_of_key, (km, power) in zip(np.split(known[np.argsort(key.reshape(-1), kind="stable")], np.cumsum(np.bincount(key.reshape(-1)))[:-1]), keys):
                low, high = (np.floor(km * share + 0.5) for share in ORIGIN_KM)
                kept = (kinds[:, 0] >= low) & (kinds[:, 0] <= high) & (np.abs(kinds[:, 1] - power) <= max(np.floor(power * 0.1 + 0.5), 15))
                at = np.flatnonzero(kept[kind])
                if not len(at):
                    continue
                start = np.flatnonzero(np.diff(vehicle[at], prepend=-1) != 0)
                prices, vehicles, times = price[at[start]].astype(float), vehicle[at[start]], np.add.reduceat(listed[at], start)
                n, mine = len(prices), own[rows_of_key]
                found = np.minimum(np.searchsorted(vehicles, mine), n - 1)
                alone = (vehicles[found] == mine) & (times[found] == 1)
                before, mid, after = (prices[i] if 0 <= i < n else np.nan for i in (n // 2 - 1, n // 2, n // 2 + 1))
                p = asked[rows_of_key, 2]
                if n % 2:
                    median, without = mid, np.where(p < mid, (mid + after) / 2, np.where(p > mid, (before + mid) / 2, (before + after) / 2))
                else:
                    median, without = (before + mid) / 2, np.where(p <= before, mid, before)
                size[rows_of_key] = n - alone
                medians[rows_of_key] = np.rint(np.where(alone, without, median))
        there = size > 0
        told = rows.drop_columns(["o_vehicle"]).append_column("origin_n", pa.array(size)).append_column("origin_median", pa.array(np.where(there, medians, 0).astype(np.int32), mask=~there))
        return pa.table(told.columns, schema=schema)

    return sampled


def origin_samples(rows: DataFrame, market: DataFrame) -> DataFrame:
    """``rows`` with origin_n and origin_median: the other vehicles of the same model and country in their own market, each at its price.

    A listing itself doesn't count; another one of the same vehicle does. Rows without
    power or kilometres have no sample. The market is reduced to what is alike and how
    often it is listed, and dealt out to the three years whose rows can look at it. Rows
    meet it by model, country and year, in order of price: a sample, the same for all rows
    with equal kilometres and power but for the row itself, is a selection of the vehicles
    there, and neither samples nor pairs are shuffled. All columns of ``rows`` go through
    the tasks, so it had better have no more than are needed.
    """
    vehicle = F.xxhash64(fallback_identity(F.col("model_id"), F.col("year"), F.col("km"), F.col("price")))
    priced = market.where((F.col("price") > 0) & F.col("power_hp").isNotNull() & F.col("km").isNotNull() & F.col("model_id").isNotNull() & F.col("country").isNotNull())
    alike = priced.groupBy(*ORIGIN_KEY, "price").agg(F.count("*").alias("o_n"))
    others = alike.select(F.col("model_id").alias("o_model"), F.col("country").alias("o_country"), F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)).alias("see_year"), F.col("km").alias("o_km"), F.col("power_hp").alias("o_power"), F.col("price").alias("o_price"), vehicle.alias("o_vehicle"), "o_n")
    schema = StructType([*rows.schema.fields, StructField("origin_n", LongType()), StructField("origin_median", IntegerType())])
    placed = rows.withColumn("o_vehicle", vehicle)
    return placed.groupBy(*ORIGIN_CELL).cogroup(others.groupBy("o_model", "o_country", "see_year")).applyInArrow(_origin_of_cell(to_arrow_schema(schema)), schema)


def plausible(sampled: DataFrame, guards: Guards = GUARDS) -> Column:
    """Whether a row of origin_samples() isn't far below its own market; small samples don't speak against a listing."""
    return (F.col("origin_n") < guards.origin_least) | (F.col("price") / F.col("origin_median") >= guards.origin_ratio)
