"""Queries over what pages carry for their own scripts, over specification pages, and over the table of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.plans.registry import query
from motorlake.sources import pages, seeds, spec_pages, states
from motorlake.sources.tables import table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt out: a page takes far longer to read than its part, and a file of parts, however many, is short enough for one task."""
    return table(spark, sf_dir, "part").repartition("p_partkey")


def pointer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part whose payload lists two vehicles that share their name; every fifth page has none."""
    number = lambda c: c.cast("string")
    key = F.col("p_partkey")
    payload = F.concat(
        F.lit('[{"pinia":1},["Reactive",2],{"results":3},{"items":4,"total":5},["Set",6,7],2,{"id":8,"name":9,"price":10,"gone":-1},["ShallowRef",14],'), number(key), F.lit(','), F.get_json_object(F.to_json(F.struct(F.array("p_name").alias("a"))), "$.a").substr(F.lit(2), F.length("p_name") + 2),
        F.lit(","), number(F.col("p_size")), F.lit(","), number(key + 1), F.lit(',null,["Date","2024-05-01T00:00:00Z"],{"id":11,"name":9,"price":12,"since":13}]'),
    )
    html = F.concat(F.lit('<html><script type="application/json" id="__NUXT_DATA__" data-ssr="true">'), payload, F.lit("</script></html>"))
    return parts(spark, sf_dir).select("p_partkey", F.when(key % 5 == 0, "<html></html>").otherwise(html).alias("html"))


@query(
    "SELECT p_partkey, place, p_partkey + place AS id, p_name AS name, CASE WHEN place = 0 THEN p_size END AS price, CASE WHEN place = 1 THEN '2024-05-01T00:00:00Z' END AS since FROM part, (VALUES (0), (1)) AS p(place) WHERE p_partkey % 5 <> 0"
)
def pages_index_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicles in payloads whose objects point to each other by number."""
    return states.pointer_rows(pointer_pages(spark, sf_dir), "p_partkey", ["pinia", "results", "items"], {"id": "bigint", "name": "string", "price": "int", "since": "string"})


def component_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part whose components push two cards in three pieces, the first card again at the end, and one piece that is no text."""
    key = F.col("p_partkey").cast("string")
    card = lambda n, rating, rest: F.concat(F.lit('"carId":'), n, F.lit(f',"auRating":{rating},"vdpPath":"/pt/d/'), n, F.lit('-a-car",'), *rest)
    mine = card(key, 4, [F.lit('"sourceName":"'), F.col("p_type"), F.lit('","imageUrls":["https://i.example/a\\"b.jpg"],"isPrivateCar":true,"outgoingPath":"/pt/leads-to/site.example/1/'), key, F.lit('",')])
    other = card(F.concat(key, F.lit("0")), 2, [F.lit('"laytime":'), F.col("p_size").cast("string"), F.lit(',"youSaveDifference":-5,"isPrivateCar":false,')])
    again = card(key, 1, [F.lit('"sourceName":"again"')])
    literal = lambda c: F.concat(F.lit('<script>self.__next_f.push([1,"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    whole = F.concat(F.lit("{"), mine, other, again, F.lit("}"))
    html = F.concat(F.lit("<html><script>self.__next_f.push([0])</script>"), literal(F.left(whole, F.lit(40))), literal(F.substring(whole, 41, 60)), literal(F.substring(whole, 101, 100000)), F.lit("</html>"))
    return parts(spark, sf_dir).select("p_partkey", "p_retailprice", html.alias("html"))


CARDS_SQL = """cards AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS card, p_type AS "sourceName", NULL::BIGINT AS laytime, NULL::BIGINT AS saves, true AS private, 4 AS rating, 'https://i.example/a"b.jpg' AS image, 'site.example' AS site, CAST(p_partkey AS VARCHAR) AS site_id FROM part
  UNION ALL SELECT p_partkey, p_partkey || '0', NULL, p_size, -5, false, 2, NULL, NULL, NULL FROM part)"""


@query(f"WITH {CARDS_SQL} SELECT * FROM cards")
def pages_component_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards in the blobs that server components push."""
    found = states.component_cards(component_pages(spark, sf_dir), "p_partkey")
    return found.select("p_partkey", "card", "sourceName", "laytime", F.col("youSaveDifference").alias("saves"), F.col("isPrivateCar").alias("private"), F.col("auRating").alias("rating"), "image", "site", "site_id")


@query(f"WITH {CARDS_SQL} SELECT p_partkey, p_retailprice AS price, rating, site FROM part JOIN cards USING (p_partkey) WHERE card = CAST(p_partkey AS VARCHAR)")
def pages_base_with_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured rows completed by the card of the same number."""
    found = component_pages(spark, sf_dir)
    extras = states.component_cards(found, "p_partkey").where(F.col("card") == F.col("p_partkey").cast("string")).select("p_partkey", F.col("auRating").alias("rating"), "site")
    return pages.with_extras(found.select("p_partkey", F.col("p_retailprice").alias("price")), extras, "p_partkey")


def spec_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part with two sections of versions and a spec sheet."""
    key = F.col("p_partkey").cast("string")
    row = lambda n, power, cc: F.concat(F.lit('<tr class="x"><td><a href="/car-specs/Make/'), n, F.lit('/slug.html"><b>'), F.col("p_name"), F.lit("</b> &amp; co</a></td><td>"), F.lit(2000) + F.col("p_size"), F.lit(f"</td><td>{power}</td><td>{cc}</td></tr>"))
    html = F.concat(
        F.lit("<section><div class='versions_div' id='petrol_engines'><table><tr><th>Name</th></tr><tr><td>no link</td></tr>"), row(key, "150 HP / 110.3 kW", "1498 cm3"), F.lit('</table></div><div class="versions_div" id="diesel_engines"><table>'), row(F.concat(key, F.lit("7")), "-", ""), F.lit("</table></div></section>"),
        F.lit('<table><tr><td class="tabletd" align="right">Body :</td><td class="tabletd_right">'), F.col("p_type"), F.lit('</td></tr><tr><td class="tabletd">Num. of Doors :</td><td class="tabletd_right">5</td></tr><tr><td class="tabletd">Generation</td><td class="tabletd_right">-</td></tr>'),
        F.lit('<tr><td class="tabletd">CO2 emissions WLTP :</td><td class="tabletd_right">'), F.col("p_size"), F.lit(',5 g/km</td></tr><tr><td class="tabletd">CO2 emissions :</td><td class="tabletd_right">99 g/km (combined)</td></tr><tr><td class="tabletd">Curb Weight :</td><td class="tabletd_right"><i>1234</i> kg</td></tr></table>'),
    )
    return parts(spark, sf_dir).select("p_partkey", html.alias("html"))


@query(
    """SELECT p_partkey, 'petrol' AS section, CAST(p_partkey AS VARCHAR) AS version_id, '/car-specs/Make/' || p_partkey || '/slug.html' AS path, p_name || ' & co' AS name, CAST(2000 + p_size AS INTEGER) AS year, 150.0::DOUBLE AS power_hp, 110.3::DOUBLE AS power_kw, 1498.0::DOUBLE AS displacement_cc FROM part
    UNION ALL SELECT p_partkey, 'diesel', p_partkey || '7', '/car-specs/Make/' || p_partkey || '7/slug.html', p_name || ' & co', CAST(2000 + p_size AS INTEGER), NULL, NULL, NULL FROM part"""
)
def pages_version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that a specification page lists in its sections."""
    return spec_pages.version_rows(spec_site(spark, sf_dir), "p_partkey")


@query("SELECT p_partkey, p_type AS body, NULL::VARCHAR AS generation, 5.0::DOUBLE AS doors, p_size + 0.5::DOUBLE AS co2_wltp, 99.0::DOUBLE AS co2_nedc, 1234.0::DOUBLE AS curb_weight_kg FROM part")
def pages_spec_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version's specification by the labels of its sheet."""
    return spec_pages.spec_sheet(spec_site(spark, sf_dir), "p_partkey").select("p_partkey", "body", "generation", "doors", "co2_wltp", "co2_nedc", "curb_weight_kg")


KINDS_SQL = ", ".join(f"({i}, '{kind}', {f"'{country}'" if country else 'NULL'})" for i, (_, _, country, kind) in enumerate(seeds.SOURCES))


@query(f"SELECT kind, count(*) AS sellers, count(country) AS one_country, count(DISTINCT i) AS sources FROM supplier JOIN (VALUES {KINDS_SQL}) AS s(i, kind, country) ON s_suppkey % {len(seeds.SOURCES)} = i GROUP BY kind")
def sources_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sellers of each kind of source, those of sources with one country, and the sources, where sellers are dealt out over the sources."""
    slugs = F.array(*[F.lit(slug) for slug, *_ in seeds.SOURCES])
    sellers = table(spark, sf_dir, "supplier").select(F.get(slugs, (F.col("s_suppkey") % len(seeds.SOURCES)).cast("int")).alias("slug"))
    return sellers.join(seeds.sources(spark), "slug").groupBy("kind").agg(F.count("*").alias("sellers"), F.count("country").alias("one_country"), F.count_distinct("slug").alias("sources"))
