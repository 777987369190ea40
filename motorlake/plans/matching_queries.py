"""Queries over the links of listings to canonical models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.operators import matching
from motorlake.plans.estimate_queries import full
from motorlake.plans.registry import query
from motorlake.sources.tables import DETAILED_SQL, table

FUELS = ["Benzin", "Diesel", "Hybrid", "Elektro", "GPL", None]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("order_id")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (o % len(values)).cast("int"))
    return full(spark, sf_dir).withColumns({"make_raw": F.col("make"), "model_raw": F.split_part("model_id", F.lit("|"), F.lit(1)), "variant": F.col("title"), "fuel_raw": pick(FUELS), "gearbox": pick(["DSG", "Schaltgetriebe", "semi-automatic", None]), "gearbox_norm": pick(["auto", "manual", None])})


@query(
    f"""WITH {DETAILED_SQL}, keyed AS (SELECT lower(replace(make, '#', '-')) AS make, lower(split_part(model_id, '|', 1)) AS model, ['gasolina', 'diesel', 'híbrido', 'elétrico', NULL, NULL][order_id % 6 + 1] AS fuel FROM detailed),
    found AS (SELECT make || '|' || model || '|' || fuel AS norm_key, make, model, fuel, count(*) AS listings FROM keyed WHERE fuel IS NOT NULL GROUP BY ALL),
    held AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) || '|' || lower(p_type) || '|diesel' AS norm_key, lower(replace(p_brand, '#', '-')) AS make, lower(p_type) AS model, 'diesel' AS fuel FROM part)
    SELECT norm_key, coalesce(h.make, f.make) AS make, coalesce(h.model, f.model) AS model, coalesce(h.fuel, f.fuel) AS fuel, coalesce(listings, 0) AS listings, h.norm_key IS NULL AS is_new FROM held h FULL JOIN found f USING (norm_key)"""
)
def model_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical models after the links of all listings, where those with diesel were there before."""
    make, model = F.translate(F.lower("p_brand"), "#", "-"), F.lower("p_type")
    held = table(spark, sf_dir, "part").select(F.concat_ws("|", make, model, F.lit("diesel")).alias("norm_key"), make.alias("make"), model.alias("model"), F.lit("diesel").alias("fuel")).distinct()
    return matching.upserted_models(matching.keyed(matching.alike(_raw(spark, sf_dir))), held)


MEDIANS = ", ".join(f"CAST(round_even(quantile_cont({c}, 0.5), 0) AS INTEGER) AS m_{c}" for c in matching.SPECS)


@query(
    f"""WITH {DETAILED_SQL}, models AS (SELECT model_id, CASE WHEN count(*) % 2 = 0 THEN 1111 END AS cc, CASE WHEN count(*) % 3 <> 0 THEN 99 END AS co2, CASE WHEN count(*) % 6 IN (2, 4) THEN 77 END AS power_hp FROM detailed GROUP BY model_id),
    medians AS (SELECT model_id, {MEDIANS} FROM detailed WHERE deleted_at IS NULL GROUP BY model_id)
    SELECT model_id, coalesce(cc, m_cc) AS cc, coalesce(co2, m_co2) AS co2, coalesce(power_hp, m_power_hp) AS power_hp FROM models LEFT JOIN medians USING (model_id)"""
)
def models_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical models with the medians of their living listings in place of what they lack."""
    rows = full(spark, sf_dir)
    n = F.col("n")
    models = rows.groupBy("model_id").agg(F.count("*").alias("n")).select("model_id", F.when(n % 2 == 0, 1111).alias("cc"), F.when(n % 3 != 0, 99).alias("co2"), F.when((n % 6).isin(2, 4), 77).alias("power_hp"))
    return matching.filled_models(models, rows)


@query(f"WITH {DETAILED_SQL}, held AS (SELECT id, ['auto', 'manual', NULL, NULL][order_id % 4 + 1] AS now, ['auto', 'manual', NULL][order_id % 3 + 1] AS before FROM detailed WHERE deleted_at IS NULL) SELECT id, now AS gearbox_norm FROM held WHERE now IS DISTINCT FROM before")
def gearbox_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of gearboxes that have to be written: those that differ from what is stored."""
    return matching.gearbox_writes(_raw(spark, sf_dir))
