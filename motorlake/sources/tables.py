"""Parquet tables, and the listing-shaped view of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Countries and fuels that the view deals out.
COUNTRIES = ("PT", "DE", "FR", "BE", "NL", "ES")
FUELS = ("gasolina", "diesel", "híbrido", "phev", "elétrico")
#: Of more parts than these, which are too many to broadcast, each task hashes its share, so that order lines aren't sorted to meet them.
SENT_PARTS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each order line: the part is the model, the supplier the seller, the nation the market."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_name", "p_brand")
    if part.count() > SENT_PARTS:  # from the files' footers
        part = part.hint("shuffle_hash")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents).alias("id"),
        F.concat("p_type", F.lit("|"), (F.col("p_size") % 5).cast("string")).alias("model_id"),
        (F.year("l_shipdate") + 20).alias("year"),
        (F.col("l_quantity").cast("int") * 3000).alias("km"),
        (F.lit(18000) + F.floor("l_extendedprice") % 9000).cast("int").alias("price"),
        (F.lit(90) + (F.col("p_size") % 4) * 30).alias("power_hp"),
        pick(COUNTRIES, F.col("n_nationkey") % 6).alias("country"),
        F.col("s_name").alias("seller"),
        F.col("l_shipdate").alias("observed_at"),
        pick(FUELS, F.col("p_size") % 5).alias("fuel"),
        (F.lit(1000) + (F.col("p_size") % 7) * 250).alias("cc"),
        (F.lit(90) + (F.col("p_size") % 9) * 15).alias("co2"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("make"),
        F.col("l_orderkey").alias("order_id"),
    )


#: The same view for the oracle.
LISTINGS_SQL = """listings AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
         p_type || '|' || CAST(p_size % 5 AS VARCHAR) AS model_id,
         CAST(year(l_shipdate) + 20 AS INTEGER) AS year,
         CAST(l_quantity AS INTEGER) * 3000 AS km,
         CAST(18000 + CAST(floor(l_extendedprice) AS BIGINT) % 9000 AS INTEGER) AS price,
         90 + (p_size % 4) * 30 AS power_hp,
         list_extract(['PT', 'DE', 'FR', 'BE', 'NL', 'ES'], CAST(n_nationkey % 6 + 1 AS INTEGER)) AS country,
         s_name AS seller, l_shipdate AS observed_at,
         list_extract(['gasolina', 'diesel', 'híbrido', 'phev', 'elétrico'], CAST(p_size % 5 + 1 AS INTEGER)) AS fuel,
         1000 + (p_size % 7) * 250 AS cc, 90 + (p_size % 9) * 15 AS co2,
         p_name AS title, p_brand AS make, l_orderkey AS order_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def detailed(rows: DataFrame) -> DataFrame:
    """Listings with the fields of a full record: state, damage, address, registration, place, match, version and facts."""
    o = F.col("order_id")
    body = lambda shift: F.when((o + shift) % 3 == 0, "").when((o + shift) % 3 == 1, "cabrio")

    def known(shift: int):
        return F.struct(
            (F.col("cc") + 100 + shift).alias("cc"), (F.col("co2") + 5).alias("co2_wltp"), F.when(o % 3 != shift, F.col("co2") - 5).alias("co2_nedc"), (F.col("power_hp") + 10).alias("power"),
            body(shift).alias("derivative"), (F.col("year") - (o % 3).cast("int")).alias("gen_start"), F.when(o % 2 == 0, F.col("year") + (o % 4).cast("int") - 1).alias("gen_end"),
        )

    path = F.concat(F.lit("https://www.cars.example/"), F.lower("country"), F.when(o % 19 == 0, "/leilao/").otherwise("/carros/"), F.replace(F.lower("title"), F.lit(" "), F.lit("-")), F.lit("/x-"), o.cast("string"), F.lit(".html?from=list"))
    return rows.withColumns({
        "deleted_at": F.when(o % 23 == 0, F.col("observed_at")),
        "is_damaged": F.when(o % 17 == 0, True).when(o % 17 != 1, False),
        "detail_url": path,
        "first_registration": F.when(o % 5 == 0, F.col("observed_at").cast("date")).when(o % 5 == 1, F.date_sub(F.col("observed_at").cast("date"), 400)),
        "postal_code": F.concat(F.lpad((o % 52).cast("string"), 2, "0"), F.lit("001")),
        "region": F.when(o % 29 == 0, "Santa Cruz de Tenerife").when(o % 29 != 1, "Centro"),
        "match_confidence": F.when(o % 4 != 1, F.when(o % 4 != 3, "exato")).otherwise("designacao"),
        "version_id": F.when(o % 4 == 0, F.concat(F.lit("v"), (o % 100).cast("string"))),
        "version": F.when(o % 4 == 0, known(0)),
        "facts": F.when(o % 4 == 1, known(1)),
        "gen_ambiguous": o % 8 == 0,
        "updated_at": F.col("observed_at"),
    }).withColumns({"cc": F.when(o % 6 != 0, F.col("cc")), "co2": F.when(o % 7 != 0, F.col("co2")), "power_hp": F.when(o % 10 != 0, F.col("power_hp"))})


def _known_sql(shift: int) -> str:
    return (
        f"{{'cc': cc + {100 + shift}, 'co2_wltp': co2 + 5, 'co2_nedc': CASE WHEN order_id % 3 <> {shift} THEN co2 - 5 END, 'power': power_hp + 10, "
        f"'derivative': CASE (order_id + {shift}) % 3 WHEN 0 THEN '' WHEN 1 THEN 'cabrio' END, 'gen_start': CAST(year - order_id % 3 AS INTEGER), 'gen_end': CASE WHEN order_id % 2 = 0 THEN CAST(year + order_id % 4 - 1 AS INTEGER) END}}"
    )


#: The same view for the oracle.
DETAILED_SQL = f"""{LISTINGS_SQL},
detailed AS (SELECT * REPLACE (CASE WHEN order_id % 6 <> 0 THEN cc END AS cc, CASE WHEN order_id % 7 <> 0 THEN co2 END AS co2, CASE WHEN order_id % 10 <> 0 THEN power_hp END AS power_hp),
  CASE WHEN order_id % 23 = 0 THEN observed_at END AS deleted_at,
  CASE WHEN order_id % 17 = 0 THEN true WHEN order_id % 17 <> 1 THEN false END AS is_damaged,
  'https://www.cars.example/' || lower(country) || CASE WHEN order_id % 19 = 0 THEN '/leilao/' ELSE '/carros/' END || replace(lower(title), ' ', '-') || '/x-' || order_id || '.html?from=list' AS detail_url,
  CASE order_id % 5 WHEN 0 THEN CAST(observed_at AS DATE) WHEN 1 THEN CAST(observed_at AS DATE) - 400 END AS first_registration,
  lpad(CAST(order_id % 52 AS VARCHAR), 2, '0') || '001' AS postal_code,
  CASE WHEN order_id % 29 = 0 THEN 'Santa Cruz de Tenerife' WHEN order_id % 29 <> 1 THEN 'Centro' END AS region,
  CASE order_id % 4 WHEN 1 THEN 'designacao' WHEN 3 THEN NULL ELSE 'exato' END AS match_confidence,
  CASE WHEN order_id % 4 = 0 THEN 'v' || CAST(order_id % 100 AS VARCHAR) END AS version_id,
  CASE WHEN order_id % 4 = 0 THEN {_known_sql(0)} END AS version, CASE WHEN order_id % 4 = 1 THEN {_known_sql(1)} END AS facts,
  order_id % 8 = 0 AS gen_ambiguous, observed_at AS updated_at FROM listings)"""
