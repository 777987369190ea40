"""Links, fills and write-backs of canonical models."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake.operators import matching


def test_links(spark):
    raw = [("VW", "Golf VII", "Benzin", "1.4", 120), ("Volkswagen", "golf", "gasolina", None, None), ("VW", "Golf", "GPL", None, None), (None, "Golf", "Diesel", None, None), ("BMW", "320d", "Diesel", None, None)]
    keyed = matching.keyed(spark.createDataFrame(raw, "make_raw string, model_raw string, fuel_raw string, variant string, co2 int"))
    assert [r["norm_key"] for r in keyed.collect()] == ["volkswagen|golf|gasolina", "volkswagen|golf|gasolina", None, None, "bmw|serie-3|diesel"]
    held = spark.createDataFrame([("bmw|serie-3|diesel", "bmw", "serie-3", "diesel"), ("old|one|diesel", "old", "one", "diesel")], "norm_key string, make string, model string, fuel string")
    rows = {r["norm_key"]: (r["make"], r["model"], r["fuel"], r["listings"], r["is_new"]) for r in matching.upserted_models(keyed, held).collect()}
    assert rows == {"volkswagen|golf|gasolina": ("volkswagen", "golf", "gasolina", 2, True), "bmw|serie-3|diesel": ("bmw", "serie-3", "diesel", 1, False), "old|one|diesel": ("old", "one", "diesel", 0, False)}


def test_known_specs_stay(spark):
    models = spark.createDataFrame([("a", 1000, None, None), ("b", 1, 2, 3), ("c", None, None, None)], "model_id string, cc int, co2 int, power_hp int")
    listings = spark.createDataFrame([("a", 1500, 100, 90), ("a", 1500, 101, None), ("b", 9, 9, 9), (None, 5, 5, 5)], "model_id string, cc int, co2 int, power_hp int").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    dead = listings.limit(1).withColumn("co2", F.lit(500)).withColumn("deleted_at", F.current_timestamp())
    got = {r["model_id"]: (r["cc"], r["co2"], r["power_hp"]) for r in matching.filled_models(models, listings.unionByName(dead)).collect()}
    assert got == {"a": (1000, 100, 90), "b": (1, 2, 3), "c": (None, None, None)}


def test_a_second_run_writes_nothing(spark):
    rows = spark.createDataFrame([(1, "DSG", None), (2, "DSG", "auto"), (3, None, "manual"), (4, "semi", None)], "id int, gearbox string, gearbox_norm string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    writes = matching.gearbox_writes(rows)
    assert sorted((r["id"], r["gearbox_norm"]) for r in writes.collect()) == [(1, "auto"), (3, None)]
    after = rows.join(writes.withColumnRenamed("gearbox_norm", "new").withColumn("hit", F.lit(True)), "id", "left").withColumn("gearbox_norm", F.when(F.col("hit"), F.col("new")).otherwise(F.col("gearbox_norm")))
    assert matching.gearbox_writes(after).count() == 0


def test_keys_are_read_once_for_what_is_alike(spark):
    """Models and counts are those of every listing by itself, though alike listings are keyed as one."""
    said = [("BMW", "320d", "Diesel", None, 120), ("BMW", "320d", "Diesel", None, 120), ("bmw", "320d", "diesel", None, None), (None, "x", "Diesel", None, 1)]
    listings = spark.createDataFrame(said, "make_raw string, model_raw string, fuel_raw string, variant string, co2 int")
    held = spark.createDataFrame([("a|b|diesel", "a", "b", "diesel")], "norm_key string, make string, model string, fuel string")
    models = lambda rows: sorted(map(tuple, matching.upserted_models(matching.keyed(rows), held).collect()))
    assert matching.alike(listings).count() == 3
    assert models(matching.alike(listings)) == models(listings)
