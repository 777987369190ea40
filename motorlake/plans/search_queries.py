"""Queries of the read side: search, highlights, dashboards, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlake.functions import tax
from motorlake.functions.identity import fallback_identity
from motorlake.functions.semantics import half_even_int
from motorlake.operators import search
from motorlake.operators.search import Filters
from motorlake.plans.market_queries import IUC, ISV, TRANSPORT
from motorlake.plans.registry import query
from motorlake.sources.tables import LISTINGS_SQL, listings, table

SEARCHED = ["make", "model_id", "title"]

SHOWCASE = f"""{LISTINGS_SQL},
home AS (SELECT model_id, CAST(round_even(quantile_cont(price, 0.5), 0) AS INTEGER) AS home_price FROM listings WHERE country = 'PT' GROUP BY model_id),
taxed AS (SELECT l.*, home_price, {ISV} AS isv, {IUC} AS iuc, CASE order_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' END AS gearbox FROM listings l JOIN home USING (model_id) WHERE country <> 'PT'),
summed AS (SELECT *, CAST(price + {TRANSPORT} + floor(isv + 0.5) + floor(iuc + 0.5) + {tax.LEGALISATION} AS BIGINT) AS total_home FROM taxed),
judged AS (SELECT *, home_price - total_home AS savings, floor(((home_price - total_home) / home_price) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS savings_pct FROM summed),
offers AS (SELECT *, CASE WHEN savings_pct >= 7 THEN 'compensa' WHEN savings_pct >= 2 THEN 'marginal' ELSE 'nao_compensa' END AS verdict FROM judged),
showcase AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY model_id, year, CAST(round(km / 1000.0) * 1000 AS BIGINT), price ORDER BY savings_pct DESC, id) = 1)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign listings against the median home price of their model."""
    rows = listings(spark, sf_dir)
    home = rows.where("country = 'PT'").groupBy("model_id").agg(half_even_int(F.percentile("price", F.lit(0.5))).alias("home_price"))
    foreign = rows.where("country <> 'PT'").join(F.broadcast(home), "model_id")  # a row for each model, as many as types and kinds of parts
    parts = tax.registration_tax(F.col("fuel"), F.col("cc"), F.col("co2"), F.col("year"), F.lit(2026.5) - F.col("year"))
    gearbox = F.when(F.col("order_id") % 3 == 0, "manual").when(F.col("order_id") % 3 == 1, "auto")
    out = foreign.withColumns({"isv": parts["isv"], "iuc": tax.annual_tax(F.col("fuel"), F.col("cc"), F.col("co2"), F.col("year")), "gearbox": gearbox})
    out = out.withColumn("total_home", tax.landed_cost(F.col("price"), F.col("country"), F.col("isv"), F.col("iuc"))).withColumn("savings", F.col("home_price") - F.col("total_home"))
    out = out.withColumn("savings_pct", tax.savings_pct(F.col("savings"), F.col("home_price")))
    return out.withColumn("verdict", tax.verdict(F.col("savings_pct")))


def showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers' representatives; offers are no more than order lines, whose number is in the files' footers."""
    most = table(spark, sf_dir, "lineitem").count()
    return search.representatives(offers(spark, sf_dir), fallback_identity(F.col("model_id"), F.col("year"), F.col("km"), F.col("price")), most)


ROW = ["id", "model_id", "country", "year", "km", "price", "total_home", "savings", "savings_pct", "verdict"]
COLUMNS = ", ".join(ROW)


@query(f"WITH {SHOWCASE} SELECT {COLUMNS} FROM showcase ORDER BY savings_pct DESC NULLS FIRST, id LIMIT 24")
def search_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(showcase(spark, sf_dir), Filters(), SEARCHED).select(*ROW)


@query(f"WITH {SHOWCASE} SELECT {COLUMNS} FROM showcase ORDER BY savings_pct DESC NULLS FIRST, id LIMIT 24 OFFSET 24")
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(showcase(spark, sf_dir), Filters.parse("page=2"), SEARCHED).select(*ROW)


FACETS = "country=DE,FR&verdict=compensa&maxTotal=30000&minYear=2016&maxKm=120000&fuel=gasolina&gearbox=manual&sort=price"


@query(f"WITH {SHOWCASE} SELECT {COLUMNS} FROM showcase WHERE country IN ('DE', 'FR') AND verdict = 'compensa' AND total_home <= 30000 AND year >= 2016 AND km <= 120000 AND fuel = 'gasolina' AND gearbox = 'manual' ORDER BY price, id LIMIT 24")
def search_faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(showcase(spark, sf_dir), Filters.parse(FACETS), SEARCHED).select(*ROW)


@query(f"WITH {SHOWCASE} SELECT count(*) AS total FROM showcase WHERE country IN ('DE', 'FR') AND verdict = 'compensa' AND total_home <= 30000 AND year >= 2016 AND km <= 120000 AND fuel = 'gasolina' AND gearbox = 'manual'")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total(showcase(spark, sf_dir), Filters.parse(FACETS), SEARCHED)


@query(f"WITH {SHOWCASE} SELECT {COLUMNS} FROM showcase WHERE contains(lower(concat_ws(' ', make, model_id, title)), 'ring') AND contains(lower(concat_ws(' ', make, model_id, title)), 'small') ORDER BY savings DESC NULLS FIRST, id LIMIT 24")
def search_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(showcase(spark, sf_dir), Filters.parse("q=Ring small&sort=savings"), SEARCHED).select(*ROW)


@query(f"WITH {SHOWCASE} SELECT {COLUMNS}, place FROM (SELECT *, CAST(row_number() OVER (ORDER BY price DESC, id) - 1 AS INTEGER) AS place FROM (SELECT * FROM offers ORDER BY price DESC, id LIMIT 4))")
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four dearest offers, asked for by id, keep the order of the list."""
    rows = offers(spark, sf_dir)
    ids = [r["id"] for r in rows.orderBy(F.col("price").desc(), "id").limit(4).collect()]
    return search.in_order(rows, ids).select(*ROW, "place")


@query(f"WITH {SHOWCASE} SELECT {COLUMNS} FROM showcase WHERE verdict = 'compensa' ORDER BY savings_pct DESC, id LIMIT 10")
def top_opportunities_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return showcase(spark, sf_dir).where("verdict = 'compensa'").orderBy(F.col("savings_pct").desc(), "id").limit(10).select(*ROW)


@query(f"WITH {SHOWCASE} SELECT {COLUMNS} FROM showcase WHERE verdict = 'compensa' ORDER BY savings DESC, id LIMIT 10")
def top_opportunities_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return showcase(spark, sf_dir).where("verdict = 'compensa'").orderBy(F.col("savings").desc(), "id").limit(10).select(*ROW)


@query(f"WITH {SHOWCASE} SELECT count(*) AS offers, count(*) FILTER (verdict = 'compensa') AS worthwhile, count(*) FILTER (observed_at > (SELECT max(observed_at) FROM listings) - INTERVAL 7 DAY) AS fresh, coalesce(CAST(round_even(quantile_cont(savings, 0.5), 0) AS INTEGER), 0) AS median_savings, coalesce(max(savings), 0) AS best FROM showcase")
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("now"))
    rows = showcase(spark, sf_dir).crossJoin(F.broadcast(now))  # one row
    fresh = F.count_if(F.col("observed_at") > F.col("now") - F.expr("interval 7 days"))
    zero = F.lit(0)
    return rows.agg(F.count("*").alias("offers"), F.count_if(F.col("verdict") == "compensa").alias("worthwhile"), fresh.alias("fresh"), F.coalesce(half_even_int(F.percentile("savings", F.lit(0.5))), zero).alias("median_savings"), F.coalesce(F.max("savings"), zero).alias("best"))


@query(f"WITH {SHOWCASE} SELECT country, count(*) AS n, CAST(round(avg(savings)) AS BIGINT) AS mean_savings FROM showcase WHERE verdict <> 'nao_compensa' GROUP BY country")
def country_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return showcase(spark, sf_dir).where("verdict <> 'nao_compensa'").groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("savings")).cast("bigint").alias("mean_savings"))


@query(f"WITH {LISTINGS_SQL} SELECT model_id, strftime(observed_at, '%Y-%m') AS month, CAST(round(avg(price)) AS BIGINT) AS price FROM listings WHERE country = 'PT' AND observed_at > (SELECT max(observed_at) FROM listings) - INTERVAL 6 MONTH GROUP BY ALL")
def listing_detail_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("now"))
    rows = listings(spark, sf_dir).where("country = 'PT'").crossJoin(F.broadcast(now)).where(F.col("observed_at") > F.add_months("now", -6))
    return rows.groupBy("model_id", F.date_format("observed_at", "yyyy-MM").alias("month")).agg(F.round(F.avg("price")).cast("bigint").alias("price"))


@query(f"WITH {SHOWCASE} SELECT (SELECT count(*) FROM listings) AS listings, (SELECT count(DISTINCT country) FROM offers) AS countries, (SELECT count(*) FROM supplier) AS sellers, max(savings) AS best FROM showcase")
def landing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [listings(spark, sf_dir).agg(F.count("*").alias("listings")), table(spark, sf_dir, "supplier").agg(F.count("*").alias("sellers")), showcase(spark, sf_dir).agg(F.count_distinct("country").alias("countries"), F.max("savings").alias("best"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2]).select("listings", "countries", "sellers", "best")  # one row each


@query(f"WITH {LISTINGS_SQL} SELECT seller, max(observed_at) AS last_seen, CAST(date_diff('hour', max(observed_at), (SELECT max(observed_at) FROM listings)) AS BIGINT) AS hours, count(*) AS n FROM listings GROUP BY seller")
def data_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("now"))
    rows = listings(spark, sf_dir).groupBy("seller").agg(F.max("observed_at").alias("last_seen"), F.count("*").alias("n")).crossJoin(F.broadcast(now))
    hours = F.floor((F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))) / 3600)
    return rows.select("seller", "last_seen", hours.alias("hours"), "n")


@query(f"WITH {SHOWCASE} SELECT DISTINCT make, split_part(model_id, '|', 1) AS family FROM showcase WHERE verdict = 'compensa'")
def alert_family_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return showcase(spark, sf_dir).where("verdict = 'compensa'").select("make", F.substring_index("model_id", "|", 1).alias("family")).distinct()


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def favorites_dead_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's favourites: living ones first, then the newest."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") == "F", F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place"))
