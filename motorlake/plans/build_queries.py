"""Queries over a catalog built in one piece: parts are its versions, their brands, types, bodies and sizes its models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.operators import catalog_build
from motorlake.plans.registry import query
from motorlake.sources.tables import table

#: What the second word of a part's name is called in a slug: a plain body, a face-lift, a body of its own, or as it is.
BODY_SQL = "CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'Sedan' WHEN 'bolt' THEN 'LCI' WHEN 'plate' THEN 'Touring' ELSE split_part(p_name, ' ', 2) END"


def _body() -> Column:
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    return F.when(word == "ring", "Sedan").when(word == "bolt", "LCI").when(word == "plate", "Touring").otherwise(word)


def _picked(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def raw_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Models and versions as a source of specifications lists them."""
    part = table(spark, sf_dir, "part")
    key, chassis = F.col("p_partkey"), F.floor(F.col("p_size") / 13).cast("int")
    mid = F.concat_ws("/", "p_brand", "p_type", _body(), chassis)
    slug = F.concat("p_type", F.lit("-"), _body(), F.lit("-E"), (chassis + 30).cast("string"))
    models = part.select(mid.alias("mid"), F.col("p_brand").alias("make"), slug.alias("slug"), F.when(chassis < 3, chassis * 6 + 1992).alias("model_year")).distinct()
    electric = key % 3 == 2
    versions = part.select(
        key.cast("string").alias("version_id"), mid.alias("mid"), F.concat_ws(" ", "p_name", _picked(["GTI", "R-Line 2.0", "Competition", "320d xDrive"], key % 4)).alias("name"),
        _picked(["petrol", "diesel", "electric"], key % 3).alias("section"), F.lit(None).cast("string").alias("fuel"), F.when(key % 5 != 0, F.col("p_size") + 1988).cast("int").alias("year"),
        (F.lit(90) + key % 12 * 15).cast("int").alias("power_hp"), F.lit(None).cast("int").alias("power_kw"), F.when(electric, 40 + key % 5 * 10).otherwise(1000 + key % 5 * 250).cast("int").alias("cc"),
        (100 + key % 7 * 10).cast("int").alias("co2_wltp"), (90 + key % 7 * 8).cast("int").alias("co2_nedc"), F.when(key % 8 != 0, 3 + key % 3).cast("int").alias("doors"),
        _picked(["6 speed Manual", "DSG", "semi-automatic", None], F.floor(key / 4) % 4).alias("gearbox"), F.concat(F.lit("N47 d-"), (key % 10).cast("string")).alias("engine_code"),
    )
    return models, versions


BUILT = f"""built_models AS (SELECT DISTINCT p_brand, p_type, {BODY_SQL} AS body, CAST(p_size // 13 AS INTEGER) AS chassis FROM part),
built_years AS (SELECT concat_ws('/', p_brand, p_type, {BODY_SQL}, CAST(p_size // 13 AS INTEGER)) AS mid, min(CASE WHEN p_partkey % 5 <> 0 THEN 1988 + p_size END) AS first_year FROM part GROUP BY 1),
built_named AS (SELECT concat_ws('/', p_brand, p_type, body, chassis) AS mid, lower(replace(p_brand, '#', '-')) AS make, lower(p_type) AS family, CASE WHEN body NOT IN ('Sedan', 'LCI') THEN lower(body) END AS word,
  concat_ws('-', lower(p_type), CASE WHEN body NOT IN ('Sedan', 'LCI', 'Touring') THEN body END, 'e' || (30 + chassis)) AS generation_key, CASE WHEN chassis < 3 THEN 1992 + 6 * chassis END AS model_year FROM built_models),
built_lines AS (SELECT mid, make, family, generation_key, least(model_year, first_year) AS start_year, CASE WHEN word IS NULL OR count(*) OVER (PARTITION BY make, family, word) = count(*) OVER (PARTITION BY make, family) THEN '' ELSE word END AS derivative FROM built_named JOIN built_years USING (mid)),
built_keys AS (SELECT make, family, derivative, generation_key, min(start_year) AS start_year FROM built_lines GROUP BY ALL),
built_steps AS (SELECT *, CASE WHEN start_year - lag(start_year) OVER (PARTITION BY make, family, derivative ORDER BY start_year, generation_key) < 2 THEN 0 ELSE 1 END AS fresh FROM built_keys WHERE start_year IS NOT NULL),
built_numbers AS (SELECT *, sum(fresh) OVER (PARTITION BY make, family, derivative ORDER BY start_year, generation_key) - 1 AS number FROM built_steps),
built_windows AS (SELECT make, family, derivative, number, min(start_year) AS first FROM built_numbers GROUP BY ALL),
built_open AS (SELECT *, lead(first) OVER (PARTITION BY make, family, derivative ORDER BY number) - 1 AS gen_end FROM built_windows),
built_generations AS (SELECT make, family, derivative, generation_key, number, CASE WHEN number = 0 THEN first - 1 ELSE first END AS gen_start, gen_end FROM built_numbers JOIN built_open USING (make, family, derivative, number)
  UNION ALL SELECT make, family, derivative, generation_key, (SELECT count(*) FROM built_windows w WHERE w.make = k.make AND w.family = k.family AND w.derivative = k.derivative), NULL, NULL FROM built_keys k WHERE start_year IS NULL),
built AS (SELECT mid, make, family, derivative, make || '|' || family || '|' || CASE WHEN derivative = '' THEN 'base' ELSE derivative END || '#' || CAST(number AS BIGINT) AS generation_id, CAST(gen_start AS INTEGER) AS gen_start, CAST(gen_end AS INTEGER) AS gen_end
  FROM built_lines JOIN built_generations USING (make, family, derivative, generation_key))"""


@query(f"WITH {BUILT} SELECT mid, make, family, 'normmodel:fallback' AS rule, derivative, generation_id, gen_start, gen_end FROM built")
def catalog_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family, derivative and generation of every model of the built catalog."""
    built = catalog_build.build(*raw_catalog(spark, sf_dir))
    return built.mids.select("mid", "make", "family", "rule", "derivative", "generation_id", "gen_start", "gen_end")


@query(f"""WITH {BUILT} SELECT CAST(p_partkey AS VARCHAR) AS version_id, make, family, derivative, generation_id, gen_start, gen_end,
  CASE p_partkey % 3 WHEN 0 THEN 'gasolina' WHEN 1 THEN 'diesel' ELSE 'elétrico' END AS fuel, CAST(CASE WHEN p_partkey % 3 = 2 THEN 40 + p_partkey % 5 * 10 ELSE 1000 + p_partkey % 5 * 250 END AS INTEGER) AS cc,
  lower(p_name) || ' ' || list_extract(['gti', 'r-line 2.0', 'competition', '320d xdrive'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS tokens, list_extract(['gti', '', 'competition', ''], CAST(p_partkey % 4 + 1 AS INTEGER)) AS trims,
  CASE p_partkey // 4 % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' END AS gearbox, 'N47D' || (p_partkey % 10) AS engine_code
  FROM part JOIN built ON mid = concat_ws('/', p_brand, p_type, {BODY_SQL}, CAST(p_size // 13 AS INTEGER))""")  # fmt: skip
def catalog_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version that can be matched, in its generation, with what the resolver reads of it."""
    rows = catalog_build.build(*raw_catalog(spark, sf_dir)).versions
    return rows.select("version_id", "make", "family", "derivative", "generation_id", "gen_start", "gen_end", "fuel", "cc", F.array_join("tokens", " ").alias("tokens"), F.array_join("trims", " ").alias("trims"), "gearbox", "engine_code")
