"""Queries over the catalog's index and over pages that hold its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.operators import catalog, families
from motorlake.plans.registry import query
from motorlake.sources import pages
from motorlake.sources.tables import table

#: Versions of the catalog made from parts: five kinds of own fuel, six sections, names with and without plug-in marks.
VERSIONS_SQL = """versions AS (SELECT p_partkey AS version_id, p_brand AS mid, list_extract(['petrol', 'diesel', 'electric', 'pluginhybrid', 'other', NULL], CAST(p_partkey % 6 + 1 AS INTEGER)) AS section,
  list_extract(['', 'Petrol / plug-in', 'mild hybrid diesel', 'Full Hybrid', 'LPG', NULL, ' Electric '], CAST(p_partkey % 7 + 1 AS INTEGER)) AS fuel,
  p_name || CASE p_partkey % 4 WHEN 0 THEN ' DM-i 1.5 Plug-in' WHEN 1 THEN ' 2,0 -TDI- (150)' ELSE '' END AS name, CAST(1990 + p_size AS INTEGER) AS year, CAST(p_size AS INTEGER) AS cc FROM part)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (key % n + 1).cast("int"))
    name = F.concat("p_name", F.when(key % 4 == 0, " DM-i 1.5 Plug-in").when(key % 4 == 1, " 2,0 -TDI- (150)").otherwise(""))
    return table(spark, sf_dir, "part").select(
        key.alias("version_id"), F.col("p_brand").alias("mid"), pick(["petrol", "diesel", "electric", "pluginhybrid", "other", None], 6).alias("section"),
        pick(["", "Petrol / plug-in", "mild hybrid diesel", "Full Hybrid", "LPG", None, " Electric "], 7).alias("fuel"), name.alias("name"), (F.col("p_size") + 1990).cast("int").alias("year"), F.col("p_size").cast("int").alias("cc"),
    )


@query(
    f"""WITH {VERSIONS_SQL}, cleaned AS (SELECT *, lower(trim(coalesce(fuel, ''))) AS own FROM versions),
    fuelled AS (SELECT * EXCLUDE (fuel), CASE WHEN section = 'other' THEN NULL WHEN contains(own, 'plug-in') THEN 'phev' WHEN own LIKE 'mild%diesel%' THEN 'diesel' WHEN own LIKE 'mild%' THEN 'gasolina' WHEN contains(own, 'hybrid') THEN 'híbrido' WHEN contains(own, 'electric') THEN 'elétrico'
      WHEN own LIKE 'lpg%' THEN NULL WHEN regexp_matches(lower(name), 'plug[- ]?in|phev|\\bdm-?i\\b') THEN 'phev' ELSE CASE section WHEN 'petrol' THEN 'gasolina' WHEN 'diesel' THEN 'diesel' WHEN 'electric' THEN 'elétrico' WHEN 'pluginhybrid' THEN 'phev' END END AS fuel FROM cleaned),
    first AS (SELECT mid, min(year) AS first_year, count(*) AS model_versions FROM versions GROUP BY mid)
    SELECT version_id, fuel, CASE WHEN fuel = 'phev' AND section = 'electric' THEN CASE WHEN version_id % 4 = 0 THEN 1500 WHEN version_id % 4 = 1 THEN 2000 END ELSE cc END AS cc, first_year, model_versions,
      lower(replace(replace(replace(name, ' (150)', ' 150'), '-TDI-', 'TDI'), '2,0', '2 0')) AS tokens FROM fuelled JOIN first USING (mid) WHERE fuel IS NOT NULL"""
)
def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that can be matched, with their fuel, displacement, tokens and model."""
    models = table(spark, sf_dir, "part").select(F.col("p_brand").alias("mid"), F.col("p_brand").alias("make"), F.col("p_brand").alias("family")).distinct()
    index = catalog.version_index(models, versions(spark, sf_dir))
    return index.select("version_id", "fuel", "cc", "first_year", "model_versions", F.array_join("tokens", " ").alias("tokens"))


def vehicle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold one vehicle each as embedded JSON, as linked data, as labelled rows and as photos."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    props = F.to_json(F.struct(F.struct(F.struct("p_partkey", "p_name", "p_retailprice").alias("ad")).alias("props")))
    linked = F.to_json(F.struct(F.lit("Car").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_retailprice").alias("price")).alias("offers")))
    html = F.concat(
        F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), props, F.lit('</script><script type="application/ld+json">'), linked, F.lit('</script><script type="application/ld+json">{"@type":"Shop"}</script>'),
        F.lit("<table><tr><td>Size</td><td>"), size, F.lit("</td></tr><tr><td>Size</td><td>0</td></tr><tr><th>Type &amp; trim</th><td><b>"), F.col("p_type"), F.lit("</b></td></tr><tr><td>Colour</td><td>-</td></tr></table>"),
        F.lit('<img src="https://i.example/'), key, F.lit('.jpg"><img src="https://i.example/'), key, F.lit('.jpg"><img src="/logo.png"><img src="https://i.example/x.svg"></html>'),
    )
    return table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))


@query("SELECT p_partkey, p_partkey AS ad, p_name AS name, p_retailprice AS price FROM part")
def pages_embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle in the state that a page embeds."""
    data = pages.next_data(F.col("html"))
    return vehicle_pages(spark, sf_dir).select("p_partkey", pages.pick(data, "$.props.ad.p_partkey", "bigint").alias("ad"), pages.pick(data, "$.props.ad.p_name").alias("name"), pages.pick(data, "$.props.ad.p_retailprice", "double").alias("price"))


@query("SELECT p_partkey, p_name AS name, p_retailprice AS price, 2 AS blocks FROM part")
def pages_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle in a page's linked data, among other things."""
    found = vehicle_pages(spark, sf_dir).withColumn("blocks", pages.linked_data(F.col("html")))
    car = F.get(F.filter("blocks", lambda b: F.get_json_object(b, "$['@type']") == "Car"), F.lit(0))
    return found.select("p_partkey", pages.pick(car, "$.name").alias("name"), pages.pick(car, "$.offers.price", "double").alias("price"), F.size("blocks").alias("blocks"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_type AS type, 2 AS labels, 'https://i.example/' || p_partkey || '.jpg' AS photos FROM part")
def pages_labels_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows, the first of a label, none for a missing value; and the photos of a page."""
    found = vehicle_pages(spark, sf_dir).withColumn("labels", pages.labelled_rows(F.col("html")))
    label = lambda name: F.try_element_at(F.col("labels"), F.lit(name))
    return found.select("p_partkey", label("Size").alias("size"), label("Type & trim").alias("type"), F.size("labels").alias("labels"), F.array_join(pages.gallery(F.col("html")), ",").alias("photos"))


@query("SELECT p_brand, 'https://c.example/' || p_partkey AS address FROM part")
def sitemap_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of sitemaps, a map for each brand."""
    line = F.concat(F.lit("<url><loc> https://c.example/"), F.col("p_partkey").cast("string"), F.lit("\n</loc></url>"))
    maps = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(line), ""), F.lit("</urlset>")).alias("xml"))
    return maps.select("p_brand", F.explode(pages.sitemap(F.col("xml"))).alias("address"))


@query("SELECT p_partkey, p_name AS name, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END) AS price, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS trim FROM part")
def pages_with_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured rows completed by what the cards of a page add."""
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))
    extras = part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("double").alias("price"), F.col("p_type").alias("trim"))
    return pages.with_extras(rows, extras, "p_partkey")


#: Makes and raw slugs of the catalog, with the family and rule that each has to get.
NAMED_MODELS = [
    ("Mercedes-Benz", "C-(W203)-Sportcoupe", "classe-c", "exception"),
    ("Mercedes-Benz", "GLC-Coupe", "glc", "mb:glc"),
    ("Mercedes-Benz", "W205-C-Class", "classe-c", "mb:class-c"),
    ("Mercedes-AMG", "E-W213-Facelift", "classe-e", "mb:class-e"),
    ("Mercedes-Benz", "W124", "w124", "mb:chassis-only"),
    ("Mercedes-Benz", "AMG-GT-4-door", "amg-gt", "mb:amg-gt"),
    ("Mercedes-Benz", "V-Class-2014", "v", "mb:class-v"),
    ("Mercedes-Benz", "170-V", "170", "mb:fallback"),
    ("Mini", "F60-Countryman", "countryman", "mini:chassis"),
    ("Mini", "J01-Hatch-Electric", "mini-cooper", "mini:chassis"),
    ("BMW", "E46-3-Series", "serie-3", "normmodel:rule"),
    ("BMW", "E39-LCI-5-Series", "serie-5", "normmodel:rule"),
    ("Land Rover", "L663-Defender-90", "defender", "normmodel:fallback"),
    ("VW", "T5-Multivan", "transporter", "vw:transporter"),
    ("Volkswagen", "Golf-7-Variant", "golf", "normmodel:fallback"),
    ("Hyundai", "Grand-i10", "grand", "normmodel:fallback"),
    ("Peugeot", "!!!", None, None),
    (None, "Golf", None, None),
]
#: Raw slugs with the generation key that each has to get.
KEYED_SLUGS = [("E46-3-Series-Touring", "e46-3-series"), ("Golf-7-Variant-Facelift", "golf-7"), ("Clio-4-5-doors", "clio-4"), ("Sedan", "sedan"), ("LCI-F30-3-Series-Sedan", "f30-3-series"), ("Leon-3-Sportstourer", "leon-3-sportstourer")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in (i, *row)) + ")" for i, row in enumerate(rows))


def _dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Each part with one of ``rows``, in turn."""
    cases = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(row, columns, strict=True)]) for row in rows])
    return table(spark, sf_dir, "part").select("p_partkey", F.get(cases, (F.col("p_partkey") % len(rows)).cast("int")).alias("case")).select("p_partkey", "case.*")


@query(f"SELECT p_partkey, make, slug, family, rule FROM part JOIN (VALUES {_values(NAMED_MODELS)}) AS n(i, make, slug, family, rule) ON p_partkey % {len(NAMED_MODELS)} = i")
def catalog_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of a catalog model, and the rule that gave it."""
    dealt = _dealt(spark, sf_dir, [row[:2] for row in NAMED_MODELS], ["make", "slug"])
    return families.with_families(dealt).select("p_partkey", "make", "slug", "family", "rule")


@query(f"SELECT p_partkey, slug, generation FROM part JOIN (VALUES {_values(KEYED_SLUGS)}) AS n(i, slug, generation) ON p_partkey % {len(KEYED_SLUGS)} = i")
def generation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a slug to tell generations apart."""
    return _dealt(spark, sf_dir, [row[:1] for row in KEYED_SLUGS], ["slug"]).select("p_partkey", "slug", catalog.generation_key(F.col("slug")).alias("generation"))
