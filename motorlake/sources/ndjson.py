"""NDJSON feeds of listing records, read in batch or as a stream with one explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlake.functions import text
from motorlake.functions.semantics import half_up, whole_number

#: Every field of a record as text; feeds disagree about types. ``_bad`` holds lines that aren't JSON.
FIELDS = (
    "id make model variant year km doors price cash_price currency fuel gearbox engine co2 color category country region postalCode seller_type source source_site seller_name vin "
    "power_hp power_cv engine_power_cv power_ch power power_kw first_registration detail_url image collected_at event"
).split()
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("_bad", T.StringType())])


def source_name(file_name: Column) -> Column:
    """The source in a file name: without the ending, the time stamp and -events."""
    return F.regexp_replace(F.regexp_replace(file_name, r"\.(nd)?json(\.gz)?$", ""), r"(-events|-\d{4}-?\d{2}-?\d{2}[T\d:.Z-]*)+$", "")


def read(spark: SparkSession, path: str, glob: str = "*.ndjson") -> DataFrame:
    """All records with _file, _source, _offset and _bad, in no order; sort by _source and _file where batch files have to come before event logs."""
    rows = spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", glob).json(path)
    return rows.withColumns({"_file": F.col("_metadata.file_name"), "_source": source_name(F.col("_metadata.file_name")), "_offset": F.col("_metadata.file_block_start")})


def read_stream(spark: SparkSession, path: str, glob: str = "*.ndjson") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", glob).json(path)


def external_id(identifier: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(identifier), F.lit("")), F.substring(F.sha2(url, 256), 1, 16))


def power(row: dict[str, Column]) -> Column:
    structured = whole_number(F.coalesce(*[row[c] for c in ("power_hp", "power_cv", "engine_power_cv", "power_ch", "power")]), 6)
    kilowatts = whole_number(row["power_kw"], 6)
    in_text = text.power_in_text(F.concat_ws(" ", row["variant"], row["model"], row["engine"]))
    return F.coalesce(F.when(structured.between(20, 2000), structured), F.when(kilowatts.between(15, 1500), half_up(kilowatts * 1.35962)), in_text).cast("int")


def seller_type(kind: Column, source: Column) -> Column:
    s = F.lower(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.nullif(F.trim(source), F.lit(""))))
    return F.when(s.rlike("priv|particular"), "particular").when(s.isNotNull(), "stand")


def records(rows: DataFrame) -> DataFrame:
    """Typed listings. Lines that aren't JSON and records with neither id nor URL are left out; dirty numbers become null."""
    c = {f: F.col(f) for f in FIELDS}
    number = lambda f, digits=9: whole_number(c[f], digits).cast("int")
    make = text.norm_make(c["make"])
    fuel = text.norm_fuel(c["fuel"], c["variant"], text.co2_grams(c["co2"]))
    model = text.norm_model(make, c["model"], c["variant"])
    cash, price = number("cash_price"), number("price")
    out = rows.where(F.col("_bad").isNull()).select(
        F.coalesce(c["source_site"], c["source"]).alias("source_site"),
        external_id(c["id"], c["detail_url"]).alias("external_id"),
        make.alias("make"), model.alias("model"), fuel.alias("fuel"), text.norm_key(make, model, fuel).alias("norm_key"),
        text.clean(c["variant"]).alias("variant"), number("year", 4).alias("year"), number("km").alias("km"), number("doors", 2).alias("doors"),
        F.when(cash > 0, cash).otherwise(price).alias("price"), F.when(cash > 0, price).alias("financed_price"),
        text.norm_gearbox(c["gearbox"]).alias("gearbox"), text.displacement(c["engine"]).alias("cc"), text.co2_grams(c["co2"]).cast("int").alias("co2"), power(c).alias("power_hp"),
        text.country_code(c["country"]).alias("country"), c["region"].alias("region"), c["postalCode"].alias("postal_code"), seller_type(c["seller_type"], c["source"]).alias("seller_type"),
        F.upper(c["vin"]).alias("vin"), c["detail_url"].alias("detail_url"), text.first_registration(c["first_registration"]).alias("first_registration"),
        c["collected_at"].try_cast("timestamp_ntz").alias("seen_at"), F.when(c["event"] == "price_change", "price_change").otherwise("new").alias("event"),
    )
    return out.where("external_id is not null")
