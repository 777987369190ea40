"""Queries over eligibility, estimates, their data and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.operators import estimates, market
from motorlake.functions import tax
from motorlake.plans.market_queries import AGE, ISV, IUC, STATISTICS, TRANSPORT
from motorlake.plans.registry import kept, query
from motorlake.sources.tables import DETAILED_SQL, detailed, listings

#: When the queries take place.
NOW = "TIMESTAMP '1999-01-01 00:00:00'"

ELIGIBLE = """country IN ('DE', 'FR', 'BE', 'NL', 'ES') AND deleted_at IS NULL AND model_id IS NOT NULL AND is_damaged IS NOT true AND detail_url NOT LIKE '%/leilao/%' AND price > 0 AND year IS NOT NULL AND km > 6000
  AND fuel IS NOT NULL AND (first_registration IS NULL OR first_registration <= DATE '1998-07-01')
  AND NOT (country = 'ES' AND (substring(postal_code, 1, 2) IN ('07', '35', '38') OR coalesce(region, '') ILIKE '%tenerife%'))"""


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(listings(spark, sf_dir))


@query(f"WITH {DETAILED_SQL} SELECT country, fuel, count(*) AS listings, count(*) FILTER ({ELIGIBLE}) AS eligible FROM detailed GROUP BY ALL")
def eligible_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings of each country and fuel can have an estimate."""
    return full(spark, sf_dir).groupBy("country", "fuel").agg(F.count("*").alias("listings"), F.count_if(estimates.eligible(F.expr(NOW))).alias("eligible"))


@query(f"WITH {DETAILED_SQL} SELECT id FROM detailed WHERE order_id % 3 = 0 AND NOT ({ELIGIBLE})")
def orphaned_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored estimates whose listing can't have one any more."""
    return full(spark, sf_dir).where((F.col("order_id") % 3 == 0) & ~estimates.eligible(F.expr(NOW))).select("id")


TIER = "CASE WHEN match_confidence = 'exato' AND version_id IS NOT NULL THEN 'exato' WHEN match_confidence = 'designacao' AND facts IS NOT NULL THEN 'designacao' END"


@query(
    f"""WITH {DETAILED_SQL}, held AS (SELECT *, order_id % 3 <> 0 AS there, {NOW} - INTERVAL 1 DAY * (order_id % 2000) AS computed_at,
    CASE order_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'designacao' ELSE 'exato' END AS match_kind, CASE order_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'cabrio' ELSE '' END AS derivative FROM detailed)
    SELECT id FROM held WHERE coalesce(NOT there OR updated_at > computed_at OR ({TIER}) IS DISTINCT FROM match_kind OR (match_confidence = 'designacao' AND facts.derivative IS DISTINCT FROM derivative)
    OR (match_confidence = 'exato' AND version_id IS NOT NULL AND derivative IS NULL), false)"""
)
def pending_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose estimate is missing or rests on data that have changed."""
    o = F.col("order_id")
    kept = F.struct(
        F.timestamp_add("DAY", -(o % 2000).cast("int"), F.expr(NOW)).alias("computed_at"),
        F.when(o % 5 == 1, "designacao").when(o % 5 != 0, "exato").alias("match_kind"),
        F.when(o % 7 == 1, "cabrio").when(o % 7 != 0, "").alias("derivative"),
    )
    return full(spark, sf_dir).withColumn("estimate", F.when(o % 3 != 0, kept)).where(estimates.stale()).select("id")


SPECS = f"""{DETAILED_SQL}, sourced AS (SELECT *, {TIER} AS match_kind, CASE {TIER} WHEN 'exato' THEN version WHEN 'designacao' THEN facts END AS s, coalesce(first_registration, make_date(year, 7, 1)) AS registered_on FROM detailed),
used AS (SELECT *, coalesce(cc, s.cc) AS cc_used, coalesce(co2, CASE WHEN year(registered_on) >= 2019 THEN s.co2_wltp ELSE s.co2_nedc END) AS co2_used, coalesce(power_hp, s.power) AS power_used, s.derivative AS derivative_used,
  CASE WHEN match_kind = 'designacao' OR NOT gen_ambiguous THEN s.gen_start END AS gen_start, CASE WHEN match_kind = 'designacao' OR NOT gen_ambiguous THEN s.gen_end END AS gen_end,
  concat_ws(',', CASE WHEN cc IS NULL AND s.cc IS NOT NULL THEN 'cc' END, CASE WHEN co2 IS NULL AND (CASE WHEN year(registered_on) >= 2019 THEN s.co2_wltp ELSE s.co2_nedc END) IS NOT NULL THEN 'co2' END, CASE WHEN power_hp IS NULL AND s.power IS NOT NULL THEN 'power' END) AS from_catalog FROM sourced)"""
SPEC_COLUMNS = ["id", "match_kind", "cc_used", "co2_used", "power_used", "derivative_used", "gen_start", "gen_end", "from_catalog"]


@query(f"WITH {SPECS} SELECT {', '.join(SPEC_COLUMNS)} FROM used WHERE power_used IS NOT NULL AND (fuel = 'elétrico' OR (cc_used IS NOT NULL AND co2_used IS NOT NULL))")
def effective_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data that an estimate rests on, and which of them came from the catalog."""
    rows = estimates.effective_specs(full(spark, sf_dir)).where(estimates.has_specs())
    return rows.withColumn("from_catalog", F.array_join("from_catalog", ",")).select(*SPEC_COLUMNS)


@query(
    f"""WITH {SPECS}, based AS (SELECT *, split_part(model_id, '|', 1) AS family, CAST(floor(km / 25000.0) AS INTEGER) AS km_band FROM used),
    keys AS (SELECT DISTINCT model_id, year, km_band, power_used AS power_hp, gen_start, gen_end, family, derivative_used AS derivative FROM based WHERE {ELIGIBLE} AND power_used IS NOT NULL),
    obs AS (SELECT *, model_id || ':' || year || ':' || CAST(round(km / 1000.0) * 1000 AS BIGINT) || ':' || price AS identity FROM based WHERE country = 'PT' AND power_used IS NOT NULL AND observed_at > {NOW} - INTERVAL 60 DAY AND observed_at <= {NOW}),
    pairs AS (SELECT k.*, o.price, o.seller, o.km, o.identity, o.observed_at, o.id, abs(o.km_band - k.km_band) <= 1 AS near FROM keys k JOIN obs o ON o.model_id = k.model_id AND o.year BETWEEN k.year - 1 AND k.year + 1
      AND (k.gen_start IS NULL OR o.year >= k.gen_start) AND (k.gen_end IS NULL OR o.year <= k.gen_end) AND o.km_band BETWEEN k.km_band - 2 AND k.km_band + 2
      AND abs(o.power_used - k.power_hp) <= greatest(floor(k.power_hp * 0.1 + 0.5), 15) AND NOT coalesce(o.family = k.family AND o.derivative_used <> k.derivative, false)),
    placed AS (SELECT *, near AND row_number() OVER (PARTITION BY model_id, year, km_band, power_hp, gen_start, gen_end, family, derivative, identity, near ORDER BY observed_at DESC, id DESC) = 1 AS p FROM pairs)
    SELECT model_id, year, km_band, power_hp, gen_start, gen_end, derivative, count(*) FILTER (p) AS n, CAST(round_even(quantile_cont(price, 0.5) FILTER (p), 0) AS INTEGER) AS median, CAST(round_even(quantile_cont(price, 0.25) FILTER (p), 0) AS INTEGER) AS p25,
      CAST(round_even(quantile_cont(price, 0.75) FILTER (p), 0) AS INTEGER) AS p75, CAST(round_even(quantile_cont(km, 0.5) FILTER (p), 0) AS INTEGER) AS median_km, count(DISTINCT price) FILTER (p) AS prices, count(DISTINCT seller) FILTER (p) AS sellers,
      min(price) FILTER (p) AS min, max(price) FILTER (p) AS max FROM placed GROUP BY model_id, year, km_band, power_hp, gen_start, gen_end, family, derivative HAVING count(*) FILTER (p) > 0"""
)
def pt_sample_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home samples of the last 60 days, within the generation and without other derivatives."""
    now = F.expr(NOW)
    rows = estimates.effective_specs(full(spark, sf_dir)).withColumns({"family": F.split_part("model_id", F.lit("|"), F.lit(1)), "km_band": market.km_band(F.col("km")), "eligible": estimates.eligible(now)})
    rows = rows.drop("power_hp").withColumnsRenamed({"power_used": "power_hp", "derivative_used": "derivative"})
    keys = rows.where("eligible and power_hp is not null").select(*market.KEY, *market.LIMITS).distinct()
    seen = market.observations(rows.where(F.col("observed_at") <= now), since=F.timestamp_add("DAY", F.lit(-market.WINDOW_DAYS), now), also=("family", "derivative"))
    return market.sample_statistics(keys, seen).where("n > 0").select(*market.KEY, "gen_start", "gen_end", "derivative", *STATISTICS)


@query(f"WITH {DETAILED_SQL} SELECT count(*) FILTER (deleted_at IS NULL) AS alive, count(*) FILTER (deleted_at IS NULL AND model_id IS NOT NULL) AS with_model, count(*) FILTER (deleted_at IS NULL AND country <> 'PT') AS abroad, CAST(round_even(avg(power_hp), 0) AS INTEGER) AS mean_power FROM detailed")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = F.col("deleted_at").isNull()
    return full(spark, sf_dir).agg(F.count_if(alive).alias("alive"), F.count_if(alive & F.col("model_id").isNotNull()).alias("with_model"), F.count_if(alive & (F.col("country") != "PT")).alias("abroad"), F.rint(F.avg("power_hp")).cast("int").alias("mean_power"))


@query(
    f"""WITH {DETAILED_SQL} SELECT seller, count(*) FILTER (match_confidence = 'exato') AS exact, count(*) FILTER (match_confidence = 'designacao') AS designation, count(*) FILTER (match_confidence IS NULL) AS none, count(*) AS alive,
    floor(count(*) FILTER (match_confidence = 'exato') * 1000.0::DOUBLE / count(*) + 0.5) / 10.0::DOUBLE AS exact_pct FROM detailed WHERE deleted_at IS NULL GROUP BY ROLLUP (seller)"""
)
def tiers_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching tiers of each source, and of all in the row without one."""
    tier = F.col("match_confidence")
    rows = full(spark, sf_dir).where("deleted_at is null").rollup("seller").agg(F.count_if(tier == "exato").alias("exact"), F.count_if(tier == "designacao").alias("designation"), F.count_if(tier.isNull()).alias("none"), F.count("*").alias("alive"))
    return rows.withColumn("exact_pct", F.floor(F.col("exact") * 1000.0 / F.col("alive") + 0.5) / 10.0)


@query(f"WITH {DETAILED_SQL} SELECT count(*) AS total, count(version_id) AS with_version, count(*) FILTER (match_confidence = 'designacao' AND facts IS NOT NULL) AS with_facts FROM detailed WHERE {ELIGIBLE}")
def estimate_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by what they rest on, read from their audit JSON."""
    inputs = F.to_json(F.struct(F.col("version_id").alias("versionId"), estimates.effective_tier().alias("matchKind")))
    rows = full(spark, sf_dir).where(estimates.eligible(F.expr(NOW))).select(inputs.alias("inputs"))
    path = lambda p: F.get_json_object("inputs", p)
    return rows.agg(F.count("*").alias("total"), F.count(path("$.versionId")).alias("with_version"), F.count_if(path("$.matchKind") == "designacao").alias("with_facts"))


#: The day that taxes hold on, and how long the home observations of the tables count: they are spread over seven years.
TAX_DAY, DAYS = "DATE '2026-07-01'", 3000

ESTIMATES = f"""{SPECS}, based AS (SELECT *, split_part(model_id, '|', 1) AS family, CAST(floor(km / 25000.0) AS INTEGER) AS km_band,
    model_id || ':' || year || ':' || CAST(round(km / 1000.0) * 1000 AS BIGINT) || ':' || price AS identity FROM used),
  asked AS (SELECT * FROM based WHERE {ELIGIBLE} AND power_used IS NOT NULL AND (fuel = 'elétrico' OR (cc_used IS NOT NULL AND co2_used IS NOT NULL))),
  e_keys AS (SELECT DISTINCT model_id, year, km_band, power_used AS power_hp, gen_start, gen_end, family, derivative_used AS derivative FROM asked),
  e_obs AS (SELECT * FROM based WHERE country = 'PT' AND power_used IS NOT NULL AND observed_at > {NOW} - INTERVAL {DAYS} DAY AND observed_at <= {NOW}),
  e_pairs AS (SELECT k.*, o.price, o.seller, o.km, o.identity, o.observed_at, o.id, abs(o.km_band - k.km_band) <= 1 AS near FROM e_keys k JOIN e_obs o ON o.model_id = k.model_id AND o.year BETWEEN k.year - 1 AND k.year + 1
    AND (k.gen_start IS NULL OR o.year >= k.gen_start) AND (k.gen_end IS NULL OR o.year <= k.gen_end) AND o.km_band BETWEEN k.km_band - 2 AND k.km_band + 2
    AND abs(o.power_used - k.power_hp) <= greatest(floor(k.power_hp * 0.1 + 0.5), 15) AND NOT coalesce(o.family = k.family AND o.derivative_used <> k.derivative, false)),
  e_placed AS (SELECT *, row_number() OVER (PARTITION BY model_id, year, km_band, power_hp, gen_start, gen_end, family, derivative, identity ORDER BY observed_at DESC, id DESC) = 1 AS w,
    near AND row_number() OVER (PARTITION BY model_id, year, km_band, power_hp, gen_start, gen_end, family, derivative, identity, near ORDER BY observed_at DESC, id DESC) = 1 AS p FROM e_pairs),
  e_stats AS (SELECT model_id, year, km_band, power_hp, gen_start, gen_end, family, derivative, {", ".join(
    f"count(*) FILTER ({f}) AS {x}n, CAST(round_even(quantile_cont(price, 0.5) FILTER ({f}), 0) AS INTEGER) AS {x}median, round_even(quantile_cont(price, 0.25) FILTER ({f}), 0) AS {x}p25, round_even(quantile_cont(price, 0.75) FILTER ({f}), 0) AS {x}p75, "
    f"round_even(quantile_cont(km, 0.5) FILTER ({f}), 0) AS {x}median_km, count(DISTINCT price) FILTER ({f}) AS {x}prices, count(DISTINCT seller) FILTER ({f}) AS {x}sellers, min(price) FILTER ({f}) AS {x}min, max(price) FILTER ({f}) AS {x}max"
    for f, x in (("p", ""), ("w", "w_")))} FROM e_placed GROUP BY ALL),
  e_judged AS (SELECT a.*, n, w_n, median, w_median,
    coalesce(n >= 5 AND prices >= 3 AND sellers >= 2 AND (p75 - p25) / median <= 0.25 AND (km + 1000) / (median_km + 1000) <= 1.6, false) AS is_normal,
    coalesce(w_n >= 3 AND w_prices >= 3 AND w_sellers >= 2 AND (w_p75 - w_p25) / w_median <= 0.25 AND (km + 1000) / (w_median_km + 1000) <= 1.6 AND (w_max - w_min) / w_median <= 0.30, false) AS is_wide
    FROM asked a JOIN e_stats s ON a.model_id = s.model_id AND a.year = s.year AND a.km_band = s.km_band AND a.power_used = s.power_hp AND a.gen_start IS NOT DISTINCT FROM s.gen_start AND a.gen_end IS NOT DISTINCT FROM s.gen_end
      AND a.family = s.family AND a.derivative_used IS NOT DISTINCT FROM s.derivative),
  e_priced AS (SELECT *, CASE WHEN is_normal THEN median ELSE w_median END AS home_price, CASE WHEN is_normal THEN n ELSE w_n END AS sample_size, CASE WHEN is_normal THEN 'normal' ELSE 'alargada' END AS confidence FROM e_judged WHERE is_normal OR is_wide),
  e_looked AS (SELECT v.id, o.price AS o_price, o.identity AS o_identity FROM e_priced v JOIN based o ON o.model_id = v.model_id AND o.country = v.country AND o.id <> v.id AND o.price > 0 AND o.deleted_at IS NULL AND o.year BETWEEN v.year - 1 AND v.year + 1
    AND o.km BETWEEN floor(v.km * 0.6 + 0.5) AND floor(v.km * 1.6 + 0.5) AND o.power_hp IS NOT NULL AND abs(o.power_hp - v.power_used) <= greatest(floor(v.power_used * 0.1 + 0.5), 15)),
  e_origin AS (SELECT id, count(*) AS origin_n, CAST(round_even(quantile_cont(o_price, 0.5), 0) AS INTEGER) AS origin_median FROM (SELECT id, o_identity, min(o_price) AS o_price FROM e_looked GROUP BY ALL) GROUP BY id),
  e_sound AS (SELECT v.* REPLACE (cc_used AS cc, co2_used AS co2, year(registered_on) AS year), (epoch({TAX_DAY}) - epoch(registered_on)) / (365.25 * 86400)::DOUBLE AS age, v.year AS listing_year, origin_n, origin_median
    FROM e_priced v LEFT JOIN e_origin USING (id) WHERE coalesce(origin_n, 0) < 5 OR price / origin_median >= 0.5),
  e_taxed AS (SELECT *, {ISV.replace(AGE, "age")} AS isv, {IUC} AS iuc, {TRANSPORT} AS transport FROM e_sound),
  e_total AS (SELECT *, CAST(price + transport + floor(isv + 0.5) + floor(iuc + 0.5) + {tax.LEGALISATION} AS BIGINT) AS total_pt FROM e_taxed),
  estimates AS (SELECT *, CASE WHEN savings_pct >= 7 THEN 'compensa' WHEN savings_pct >= 2 THEN 'marginal' ELSE 'nao_compensa' END AS verdict FROM (
    SELECT *, home_price - total_pt AS savings, floor(((home_price - total_pt) / home_price) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS savings_pct FROM e_total))"""
ESTIMATE_SQL = f"""id, price AS origin_price, transport, CAST(floor(isv + 0.5) AS INTEGER) AS isv, CAST(floor(iuc + 0.5) AS INTEGER) AS iuc, {tax.LEGALISATION} AS legalization, total_pt, home_price AS pt_estimated_price, sample_size AS pt_sample_size, confidence AS pt_confidence,
  savings, savings_pct, verdict, 2026 AS isv_table_year"""


def estimate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates of all listings, computed once for a session and folder, as the nightly run stores them."""
    return kept(spark, sf_dir, "estimates", lambda: estimates.estimate(listing_table(spark, sf_dir), F.expr(NOW), F.expr(TAX_DAY), DAYS))


def stored_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listings() as stored once for a session and folder: without what detailed() derives from a row alone, which is several times as long."""
    return kept(spark, sf_dir, "listings", lambda: listings(spark, sf_dir))


def listing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(stored_listings(spark, sf_dir)).withColumn("family", F.split_part("model_id", F.lit("|"), F.lit(1)))


@query(f"""WITH {ESTIMATES} SELECT {ESTIMATE_SQL}, strftime(registered_on, '%Y-%m-%d') AS registered, first_registration IS NULL AS assumed, match_kind, CASE WHEN origin_n >= 5 THEN origin_median END AS origin_median,
  CASE WHEN match_kind = 'exato' THEN version_id END AS version_id, CASE WHEN match_kind IS NOT NULL THEN from_catalog END AS from_catalog FROM estimates""")  # fmt: skip
def estimate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every estimate with what its audit says of the data behind it."""
    audit = "firstRegistration string, firstRegistrationAssumed boolean, matchKind string, originMedian int, versionId string, fromCatalog array<string>"
    rows = estimate_table(spark, sf_dir).withColumn("a", F.from_json("inputs", audit))
    told = {"registered": "firstRegistration", "assumed": "firstRegistrationAssumed", "match_kind": "matchKind", "origin_median": "originMedian", "version_id": "versionId"}
    return rows.select(*estimates.ESTIMATE, *(F.col(f"a.{v}").alias(k) for k, v in told.items()), F.array_join("a.fromCatalog", ",").alias("from_catalog"))
