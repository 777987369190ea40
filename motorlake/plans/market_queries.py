"""Queries over the home market: samples, taxes, verdicts, opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlake.functions import tax
from motorlake.functions.identity import fallback_identity
from motorlake.operators import market
from motorlake.plans.registry import query
from motorlake.sources.tables import LISTINGS_SQL, listings

T = tax.TABLES_2026


def _case(units: str, brackets, value) -> str:
    whens = "".join(f" WHEN {units} <= {b[0]} THEN {value(b)}" for b in brackets[:-1])
    return f"CASE{whens} ELSE {value(brackets[-1])} END"


def _linear(units: str, brackets) -> str:
    return f"greatest(0.0::DOUBLE, {_case(units, brackets, lambda b: f'{units} * {float(b[1])}::DOUBLE - {float(b[2])}::DOUBLE')})"


def _step(units: str, brackets, i: int = 1) -> str:
    return _case(units, brackets, lambda b: f"{float(b[i])}::DOUBLE")


def _round(x: str, digits: int) -> str:
    return f"(floor(({x}) * {float(10**digits)}::DOUBLE + 0.5) / {float(10**digits)}::DOUBLE)"


AGE = "(2026.5::DOUBLE - year)"
REDUCTION = "CASE" + "".join(f" WHEN {AGE} >= {a}" + (f" AND {AGE} < {b}" if b else "") + f" THEN {p}" for a, b, p in T.age) + " ELSE 0 END"
BY_CO2 = (
    f"CASE WHEN fuel = 'diesel' AND year >= 2019 THEN {_linear('co2', T.co2['diesel', 'wltp'])} WHEN fuel = 'diesel' THEN {_linear('co2', T.co2['diesel', 'nedc'])} "
    f"WHEN year >= 2019 THEN {_linear('co2', T.co2['petrol', 'wltp'])} ELSE {_linear('co2', T.co2['petrol', 'nedc'])} END"
)
RATE = "CASE WHEN fuel = 'phev' AND (year BETWEEN 2015 AND 2020 OR co2 < 50) THEN 25 WHEN fuel = 'híbrido' AND co2 < 50 THEN 60 ELSE 100 END"
ISV = f"CASE WHEN fuel = 'elétrico' THEN 0.0 ELSE {_round(f'(({_linear("cc", T.displacement)} + {BY_CO2}) * (({RATE}) / 100.0::DOUBLE) + CASE WHEN fuel = {chr(39)}diesel{chr(39)} THEN 500.0::DOUBLE ELSE 0.0::DOUBLE END) * (1.0::DOUBLE - ({REDUCTION}) / 100.0::DOUBLE)', 2)} END"


def _annual(i: int) -> str:
    return f"CASE WHEN year >= 2019 THEN {_step('co2', T.annual_co2['wltp'], i)} ELSE {_step('co2', T.annual_co2['nedc'], i)} END"


IUC = f"CASE WHEN fuel = 'elétrico' THEN 0.0 ELSE {_round(f'({_step("cc", T.annual_displacement)} + ({_annual(1)} + CASE WHEN year >= 2017 THEN {_annual(2)} ELSE 0.0::DOUBLE END)) * {_step("year", T.annual_coefficient)} + CASE WHEN fuel = {chr(39)}diesel{chr(39)} THEN {_step("cc", T.annual_diesel)} ELSE 0.0::DOUBLE END', 2)} END"
TRANSPORT = "CASE country" + "".join(f" WHEN '{c}' THEN {eur}" for c, eur in tax.TRANSPORT.items()) + " END"

SAMPLES = f"""{LISTINGS_SQL},
probe AS (SELECT *, CAST(floor(km / 25000.0) AS INTEGER) AS km_band FROM listings WHERE country <> 'PT' AND km > 6000 AND price > 0),
obs AS (SELECT id, model_id, year, km, CAST(floor(km / 25000.0) AS INTEGER) AS km_band, price, power_hp, seller, observed_at,
    model_id || ':' || year || ':' || CAST(round(km / 1000.0) * 1000 AS BIGINT) || ':' || price AS identity FROM listings WHERE country = 'PT'),
keys AS (SELECT DISTINCT model_id, year, km_band, power_hp FROM probe),
pairs AS (SELECT k.model_id, k.year, k.km_band, k.power_hp, o.price, o.seller, o.km, o.identity, o.observed_at, o.id, abs(o.km_band - k.km_band) <= 1 AS near
    FROM keys k JOIN obs o ON o.model_id = k.model_id AND o.year BETWEEN k.year - 1 AND k.year + 1 AND o.km_band BETWEEN k.km_band - 2 AND k.km_band + 2
    AND abs(o.power_hp - k.power_hp) <= greatest(floor(k.power_hp * 0.1 + 0.5), 15)),
placed AS (SELECT *, row_number() OVER (PARTITION BY model_id, year, km_band, power_hp, identity ORDER BY observed_at DESC, id DESC) = 1 AS w,
    near AND row_number() OVER (PARTITION BY model_id, year, km_band, power_hp, identity, near ORDER BY observed_at DESC, id DESC) = 1 AS p FROM pairs),
stats AS (SELECT model_id, year, km_band, power_hp, {", ".join(
    f"count(*) FILTER ({s}) AS {x}n, CAST(round_even(quantile_cont(price, 0.5) FILTER ({s}), 0) AS INTEGER) AS {x}median, CAST(round_even(quantile_cont(price, 0.25) FILTER ({s}), 0) AS INTEGER) AS {x}p25, "
    f"CAST(round_even(quantile_cont(price, 0.75) FILTER ({s}), 0) AS INTEGER) AS {x}p75, CAST(round_even(quantile_cont(km, 0.5) FILTER ({s}), 0) AS INTEGER) AS {x}median_km, "
    f"count(DISTINCT price) FILTER ({s}) AS {x}prices, count(DISTINCT seller) FILTER ({s}) AS {x}sellers, min(price) FILTER ({s}) AS {x}min, max(price) FILTER ({s}) AS {x}max"
    for s, x in (("p", ""), ("w", "w_")))} FROM placed GROUP BY ALL),
judged AS (SELECT probe.*, stats.* EXCLUDE (model_id, year, km_band, power_hp),
    coalesce(n >= 5 AND prices >= 3 AND sellers >= 2 AND (p75 - p25) / median <= 0.25 AND (km + 1000) / (median_km + 1000) <= 1.6, false) AS is_normal,
    coalesce(w_n >= 3 AND w_prices >= 3 AND w_sellers >= 2 AND (w_p75 - w_p25) / w_median <= 0.25 AND (km + 1000) / (w_median_km + 1000) <= 1.6 AND (w_max - w_min) / w_median <= 0.30, false) AS is_wide
    FROM probe LEFT JOIN stats USING (model_id, year, km_band, power_hp)),
priced AS (SELECT *, CASE WHEN is_normal THEN 'normal' WHEN is_wide THEN 'alargada' END AS confidence, CASE WHEN is_normal THEN median WHEN is_wide THEN w_median END AS home_price,
    CASE WHEN is_normal THEN n WHEN is_wide THEN w_n END AS sample_size, {ISV} AS isv, {IUC} AS iuc FROM judged),
totals AS (SELECT *, CAST(price + {TRANSPORT} + floor(isv + 0.5) + floor(iuc + 0.5) + {tax.LEGALISATION} AS BIGINT) AS total_home FROM priced WHERE home_price IS NOT NULL),
verdicts AS (SELECT *, CASE WHEN savings_pct >= 7 THEN 'compensa' WHEN savings_pct >= 2 THEN 'marginal' ELSE 'nao_compensa' END AS verdict FROM (
    SELECT *, home_price - total_home AS savings, floor(((home_price - total_home) / home_price) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS savings_pct FROM totals))"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every foreign listing with a home price, costed."""
    rows = listings(spark, sf_dir)
    return market.costed(market.home_prices(market.probes(rows), market.observations(rows)).where("home_price is not null"))


@query(f"WITH {SAMPLES} SELECT verdict, confidence, count(*) AS n, CAST(sum(savings) AS BIGINT) AS savings, CAST(sum(floor(isv + 0.5)) AS BIGINT) AS isv, CAST(sum(floor(iuc + 0.5)) AS BIGINT) AS iuc, CAST(sum(home_price) AS BIGINT) AS home_price FROM verdicts GROUP BY ALL")
def landed_cost_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.sum(c).cast("bigint")
    whole = lambda c: F.floor(F.col(c) + 0.5)
    return verdicts(spark, sf_dir).groupBy("verdict", "confidence").agg(F.count("*").alias("n"), total(F.col("savings")).alias("savings"), total(whole("isv")).alias("isv"), total(whole("iuc")).alias("iuc"), total(F.col("home_price")).alias("home_price"))


STATISTICS = ["n", "median", "p25", "p75", "median_km", "prices", "sellers", "min", "max"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return market.sample_statistics(market.probes(rows).select(*market.KEY).distinct(), market.observations(rows))


@query(f"WITH {SAMPLES} SELECT model_id, year, km_band, power_hp, {', '.join(STATISTICS)} FROM stats WHERE n > 0")
def pt_sample_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).where("n > 0").select(*market.KEY, *STATISTICS)


@query(f"WITH {SAMPLES} SELECT model_id, year, km_band, power_hp, {', '.join(f'w_{c} AS {c}' for c in STATISTICS)} FROM stats")
def pt_sample_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select(*market.KEY, *[F.col(f"w_{c}").alias(c) for c in STATISTICS])


@query(f"WITH {LISTINGS_SQL} SELECT id, isv, CAST({REDUCTION} AS INTEGER) AS reduction_pct FROM (SELECT *, {ISV} AS isv FROM listings)")
def isv_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tax.registration_tax(F.col("fuel"), F.col("cc"), F.col("co2"), F.col("year"), F.lit(2026.5) - F.col("year"))
    return listings(spark, sf_dir).select("id", parts["isv"].alias("isv"), tax.reduction_pct(F.lit(2026.5) - F.col("year")).alias("reduction_pct"))


@query(f"WITH {LISTINGS_SQL} SELECT id, {IUC} AS iuc FROM listings")
def iuc_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", tax.annual_tax(F.col("fuel"), F.col("cc"), F.col("co2"), F.col("year")).alias("iuc"))


ORIGIN = f"""{SAMPLES},
looked AS (SELECT v.id, o.price AS o_price, o.model_id || ':' || o.year || ':' || CAST(round(o.km / 1000.0) * 1000 AS BIGINT) || ':' || o.price AS o_identity
    FROM verdicts v JOIN listings o ON o.model_id = v.model_id AND o.country = v.country AND o.id <> v.id AND o.price > 0 AND o.year BETWEEN v.year - 1 AND v.year + 1
    AND o.km BETWEEN floor(v.km * 0.6 + 0.5) AND floor(v.km * 1.6 + 0.5) AND abs(o.power_hp - v.power_hp) <= greatest(floor(v.power_hp * 0.1 + 0.5), 15)),
origin AS (SELECT id, count(*) AS origin_n, CAST(round_even(quantile_cont(o_price, 0.5), 0) AS INTEGER) AS origin_median FROM (SELECT id, o_identity, min(o_price) AS o_price FROM looked GROUP BY ALL) GROUP BY id)"""


@query(f"WITH {ORIGIN} SELECT v.id, coalesce(origin_n, 0) AS origin_n, origin_median, coalesce(origin_n, 0) < 5 OR price / origin_median >= 0.5 AS plausible FROM verdicts v LEFT JOIN origin USING (id)")
def origin_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = market.origin_samples(verdicts(spark, sf_dir).select("id", *market.ORIGIN_KEY, "price"), listings(spark, sf_dir))
    return sampled.select("id", "origin_n", "origin_median", market.plausible(sampled).alias("plausible"))


IDENTITY = "model_id || ':' || year || ':' || CAST(round(km / 1000.0) * 1000 AS BIGINT) || ':' || price"


@query(f"WITH {ORIGIN} SELECT id, savings, savings_pct FROM (SELECT *, row_number() OVER (PARTITION BY {IDENTITY} ORDER BY savings_pct DESC, id) AS place FROM verdicts v LEFT JOIN origin USING (id) WHERE verdict = 'compensa' AND confidence = 'normal' AND (coalesce(origin_n, 0) < 5 OR price / origin_median >= 0.5)) WHERE place = 1")
def opportunity_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing of each vehicle among the worthwhile ones that their own market doesn't speak against: the one that saves most."""
    worthwhile = verdicts(spark, sf_dir).where("verdict = 'compensa' and confidence = 'normal'")
    sampled = market.origin_samples(worthwhile.select("id", *market.ORIGIN_KEY, "price", "savings", "savings_pct"), listings(spark, sf_dir))
    rows = sampled.where(market.plausible(sampled)).withColumn("identity", fallback_identity(F.col("model_id"), F.col("year"), F.col("km"), F.col("price")))
    best = Window.partitionBy("identity").orderBy(F.col("savings_pct").desc(), "id")
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").select("id", "savings", "savings_pct")


@query(f"WITH {SAMPLES} SELECT (SELECT count(*) FROM listings) AS listings, (SELECT count(*) FROM probe) AS eligible, (SELECT count(*) FROM judged WHERE w_n > 0) AS with_sample, (SELECT count(*) FROM totals) AS priced, (SELECT count(*) FROM verdicts WHERE verdict = 'compensa') AS worthwhile")
def eligibility_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    judged = market.costed(market.home_prices(market.probes(rows), market.observations(rows)))
    counted = judged.agg(F.count("*").alias("eligible"), F.count_if(F.col("w_n") > 0).alias("with_sample"), F.count("home_price").alias("priced"), F.count_if((F.col("verdict") == "compensa") & F.col("home_price").isNotNull()).alias("worthwhile"))
    return rows.agg(F.count("*").alias("listings")).crossJoin(counted)  # one row each


@query(f"WITH {LISTINGS_SQL} SELECT model_id, year, CAST(floor(km / 25000.0) AS INTEGER) AS km_band, count(*) AS n, count(DISTINCT price) AS prices FROM listings WHERE country = 'PT' GROUP BY ALL")
def km_band_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where("country = 'PT'").withColumn("km_band", market.km_band(F.col("km")))
    return rows.groupBy("model_id", "year", "km_band", "price").count().groupBy("model_id", "year", "km_band").agg(F.sum("count").alias("n"), F.count("*").alias("prices"))


@query(f"WITH {LISTINGS_SQL} SELECT model_id, CAST(round_even(quantile_cont(cc, 0.5), 0) AS INTEGER) AS cc, CAST(round_even(quantile_cont(co2, 0.5), 0) AS INTEGER) AS co2, CAST(round_even(quantile_cont(power_hp, 0.5), 0) AS INTEGER) AS power_hp FROM listings GROUP BY model_id")
def model_medians_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motorlake.functions.semantics import half_even_int

    return listings(spark, sf_dir).groupBy("model_id").agg(*[half_even_int(F.percentile(c, F.lit(0.5))).alias(c) for c in ("cc", "co2", "power_hp")])
