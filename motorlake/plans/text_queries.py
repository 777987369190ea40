"""Queries over the text normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.functions import text
from motorlake.functions.identity import VIN_IN_URL, car_identity
from motorlake.functions.semantics import capture
from motorlake.operators import aliases
from motorlake.plans.registry import query
from motorlake.sources.tables import table

#: Sample spellings that are dealt out over the rows of ``part`` by key.
FUEL_WORDS = ["Gasolina", "Diesel", "Plug-in-Hybrid", "Elektro", "Hybride essence", "Gasóleo", "Elektro/Benzin", "GPL", "Super", "Benzin"]
GEAR_WORDS = ["Automatik", "Schaltgetriebe", "Halbautomatik", "AUTO", "Manual 6v", "DSG", "Handgeschakeld", "", "Doppelkupplung", "unknown"]
ENGINE_WORDS = ["3.0 Gasoline", "2,0 l", "V8 4.4 Gasoline", "1.995 cm³", "1995", "TDI", "1.6 110 XDRIVE", "145cv", "100 kW", "190 PS quattro"]


def _dealt(spark: SparkSession, sf_dir: str, words: list[str]) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return parts.select("p_partkey", F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int")).alias("word"))


def _dealt_sql(words: list[str]) -> str:
    return f"(SELECT p_partkey, list_extract([{', '.join(chr(39) + w + chr(39) for w in words)}], CAST(p_partkey % {len(words)} + 1 AS INTEGER)) AS word FROM part)"


SLUG = "regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, md5({SLUG.format('text')}) AS slug_md5 FROM documents")
def slugify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.slugify(F.col("text")).cast("binary")).alias("slug_md5"))


@query(
    f"SELECT p_partkey, CASE WHEN regexp_matches(s, 'plug|phev|recharge') THEN 'phev' WHEN regexp_matches(s, 'hybrid|hibrid') OR (regexp_matches(s, 'elektro|electr|eletr') AND regexp_matches(s, 'benzin|gasolina|diesel|essence|petrol')) THEN 'híbrido' "
    f"WHEN regexp_matches(s, '^(electr|elektr|eletr)') THEN 'elétrico' WHEN s = 'd' OR regexp_matches(s, 'gasoleo|gazole|gasoil|gasolio|^diesel|^dizel') THEN 'diesel' WHEN regexp_matches(s, 'gasolina|benzin|essence|petrol|^super$') THEN 'gasolina' END AS fuel FROM (SELECT p_partkey, {SLUG.format('word')} AS s FROM {_dealt_sql(FUEL_WORDS)})"
)
def fuel_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, FUEL_WORDS).select("p_partkey", text.norm_fuel(F.col("word")).alias("fuel"))


@query(
    f"SELECT p_partkey, CASE WHEN regexp_matches(s, 'semi|halbautom|sequen') THEN NULL WHEN regexp_matches(s, 'autom|dsg|s[- ]?tronic|tiptronic|powershift|dct|edc|pdk|cvt|doppelkupp|\\bauto\\b') THEN 'auto' WHEN regexp_matches(s, 'man|schalt|schak') THEN 'manual' END AS gearbox FROM (SELECT p_partkey, lower(trim(word)) AS s FROM {_dealt_sql(GEAR_WORDS)})"
)
def gearbox_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, GEAR_WORDS).select("p_partkey", text.norm_gearbox(F.col("word")).alias("gearbox"))


@query(
    f"SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(word, '(\\d{{2,3}})\\s?(cv|ch|hp|ps)\\b', 1, 'i'), '') AS INTEGER), CAST(floor(TRY_CAST(nullif(regexp_extract(word, '(\\d{{2,3}})\\s?kw\\b', 1, 'i'), '') AS INTEGER) * 1.35962 + 0.5) AS INTEGER), "
    f"TRY_CAST(nullif(regexp_extract(word, '\\b\\d[.,]\\d\\s+(\\d{{2,3}})\\b', 1), '') AS INTEGER)) AS power_hp FROM {_dealt_sql(ENGINE_WORDS)}"
)
def power_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, ENGINE_WORDS).select("p_partkey", text.power_in_text(F.col("word")).alias("power_hp"))


@query(
    f"SELECT p_partkey, CASE WHEN cc BETWEEN 400 AND 8500 THEN cc END AS cc FROM (SELECT p_partkey, CAST(coalesce(TRY_CAST(nullif(regexp_extract(word, '\\b([1-9])[.,](\\d)\\b', 1), '') AS INTEGER) * 1000 + TRY_CAST(nullif(regexp_extract(word, '\\b([1-9])[.,](\\d)\\b', 2), '') AS INTEGER) * 100, TRY_CAST(nullif(regexp_replace(word, '[^0-9]', '', 'g'), '') AS INTEGER)) AS INTEGER) AS cc FROM {_dealt_sql(ENGINE_WORDS)})"
)
def displacement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, ENGINE_WORDS).select("p_partkey", text.displacement(F.col("word")).alias("cc"))


@query("SELECT page_id, nullif(upper(regexp_extract(replace(url, '.', '/') || '/WVWZZZ1KZ' || lpad(CAST(page_id AS VARCHAR), 8, '0'), '(?:^|[/-])([A-HJ-NPR-Za-hj-npr-z0-9]{17})(?:[/-]|$)', 1)), '') AS vin FROM pages")
def vin_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.translate("url", ".", "/"), F.lit("/WVWZZZ1KZ"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "pages").select("page_id", F.upper(capture(url, VIN_IN_URL)).alias("vin"))


@query("SELECT p_partkey, p_price + 1000 AS cash FROM (SELECT p_partkey, CAST(10000 + p_partkey % 5000 AS BIGINT) AS p_price FROM part)")
def contado_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cash price that a text names twice, beside another and one out of range."""
    price = (F.lit(10000) + F.col("p_partkey") % 5000).cast("bigint")
    said = F.concat(F.lit("Al contado: "), price + 500, F.lit(" €. Precio al contado "), price + 1000, F.lit(" eur, al contado "), price + 1000, F.lit(", al contado 99999 €"))
    return table(spark, sf_dir, "part").select("p_partkey", text.cash_price(said, price).alias("cash"))


NAMES_SQL = "names AS (SELECT DISTINCT p_brand AS block, p_type || ' ' || p_name AS name FROM part)"


@query(f"WITH {NAMES_SQL} SELECT a.block, a.name, b.name AS nearest, levenshtein(a.name, b.name)::INTEGER AS distance FROM names a JOIN names b ON a.block = b.block AND a.name <> b.name QUALIFY row_number() OVER (PARTITION BY a.block, a.name ORDER BY levenshtein(a.name, b.name), b.name) = 1")
def levenshtein_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other name of the same brand, through names that are equal without a few characters."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return aliases.nearest_names(names, names)


@query(f"""WITH listed AS (SELECT p_brand AS block, p_type || ' ' || p_name AS name, count(*) AS listings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), known AS (SELECT DISTINCT p_brand AS block, p_type || ' ' || p_name AS name FROM part WHERE p_size % 9 = 0 AND p_brand <> 'Brand#7'),
missing AS (SELECT * FROM listed ANTI JOIN known USING (block, name))
SELECT m.block, m.name, listings, k.name AS nearest, levenshtein(m.name, k.name)::INTEGER AS distance FROM missing m LEFT JOIN known k ON k.block = m.block QUALIFY row_number() OVER (PARTITION BY m.block, m.name ORDER BY levenshtein(m.name, k.name), k.name) = 1""")  # fmt: skip
def alias_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of listings that a catalog of some sizes doesn't have, with the nearest one of the brand that it does."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("block"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    return aliases.alias_gap(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), part.where("p_size % 9 = 0 and block <> 'Brand#7'"))


@query(
    "SELECT p_type || ':' || (2000 + p_size % 20) || ':' || CAST(round(p_partkey * 37 % 100000 / 1000.0) * 1000 AS BIGINT) || ':' || CAST(floor(p_retailprice) AS BIGINT) AS identity, min(p_partkey) AS first_part, count(*) AS n FROM part GROUP BY 1"
)
def car_identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vehicle, by model, year, rounded kilometres and price."""
    none = F.lit(None).cast("string")
    identity = car_identity(none, none, F.col("p_type"), F.lit(2000) + F.col("p_size") % 20, F.col("p_partkey") * 37 % 100000, F.floor("p_retailprice"))
    return table(spark, sf_dir, "part").groupBy(identity.alias("identity")).agg(F.min("p_partkey").alias("first_part"), F.count("*").alias("n"))
