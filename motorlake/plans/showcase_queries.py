"""Queries of the read side over the stored showcase: cards, search pages, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.functions.semantics import half_even_int
from motorlake.functions.text import norm_make
from motorlake.operators import alerts, showcase
from motorlake.operators.estimates import eligible
from motorlake.operators.search import Filters
from motorlake.plans.estimate_queries import ESTIMATES, NOW, estimate_table, listing_table, stored_listings
from motorlake.plans.registry import kept, query
from motorlake.session import shared_path
from motorlake.sources.tables import detailed, table


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def in_full(rows: DataFrame) -> DataFrame:
    """detailed() listings with all that a card is made of."""
    o = F.col("order_id")
    return rows.withColumns({
        "make_raw": F.when(o % 9 != 0, F.col("make")), "model_raw": F.split_part("model_id", F.lit("|"), F.lit(1)), "variant": F.when(o % 4 != 3, F.col("title")),
        "gearbox": _pick(["DSG", "Schaltgetriebe", None], o % 3), "image_url": F.when(o % 2 == 0, F.concat(F.lit("https://img.example/"), o.cast("string"), F.lit("/250x188.webp"))).otherwise("http://img.example/x.webp"),
        "vin": F.lit(None).cast("string"), "source_id": F.col("seller"), "source_site": F.concat(F.lit("site-"), F.lower("country")), "last_seen_at": F.col("observed_at"),
        "facts": F.when(F.col("facts").isNotNull(), F.col("facts").withField("mid", F.concat(F.lit("m"), (o % 10).cast("string")))),
    }).drop("title", "version", "make")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Canonical models, versions and models of the catalog, and sources."""
    rows = listing_table(spark, sf_dir)
    o = F.col("order_id")
    median = lambda c: half_even_int(F.percentile(c, F.lit(0.5))).alias(c)
    models = rows.groupBy("model_id").agg(*map(median, ("cc", "co2", "power_hp")), F.min("fuel").alias("fuel")).select("*", F.lit("Make").alias("make"), F.col("model_id").alias("model"))
    k = F.col("k")
    kth = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    versions = rows.where("order_id % 4 = 0").select((o % 100).cast("int").alias("k")).distinct().select(
        kth("v").alias("version_id"), (1300 + k % 7 * 100).alias("cc"), (110 + k).alias("co2_wltp"), F.when(k % 3 != 0, 95 + k).alias("co2_nedc"), (100 + k).alias("power"), F.when(k % 8 == 0, kth("G16 G15 8 Series ")).otherwise(kth("Plain ")).alias("name"),
        F.when(k % 16 == 0, kth("https://v.example/")).alias("image_url"), F.concat(F.lit("m"), (k % 10).cast("string")).alias("mid"),
    )
    catalog = rows.select((o % 10).cast("int").alias("k")).distinct().select(kth("m").alias("mid"), kth("Catalog ").alias("make"), F.concat(kth("Model "), F.lit(" (W212)")).alias("model"), F.when(k % 3 != 0, F.array(kth("https://m.example/"))).alias("image_urls"))
    sources = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("source_id"), F.concat(F.lit("Site "), "s_name").alias("source_name"))
    return F.broadcast(models), F.broadcast(versions), F.broadcast(catalog), sources  # models, versions and catalog are as many as types and kinds of parts, however large the tables


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cards. A source that is there several times gives each of its listings as many; so nothing is shuffled after the sources."""
    return showcase.mapped(showcase.joined(in_full(listing_table(spark, sf_dir)), estimate_table(spark, sf_dir), *sides(spark, sf_dir)))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards that representatives() would leave of cards(), chosen before anything but their estimates is joined to them.

    Listings meet their estimates once, as stored: what derives from a listing's own row
    isn't shuffled but derived again of those chosen. Who isn't eligible has no estimate.
    """
    models, versions, catalog, sources = sides(spark, sf_dir)
    found = estimate_table(spark, sf_dir).where(F.col("pt_confidence") == showcase.SHOWN_SAMPLE)
    met = stored_listings(spark, sf_dir).join(found.select("id", F.struct(*showcase.ESTIMATED).alias("e")), "id")
    judged = in_full(detailed(met.withColumn("_held", F.struct(*met.columns)))).where(eligible(F.expr(NOW))).withColumns({c: F.col(f"e.{c}") for c in ("pt_confidence", "savings")})
    best = showcase.representatives(judged).select("_held.*")
    return showcase.mapped(showcase.beside(in_full(detailed(best)), models, versions, catalog, sources.dropDuplicates(["source_id"])))


_opened: dict[tuple[str, str], showcase.Showcase] = {}


def opened(spark: SparkSession, sf_dir: str) -> showcase.Showcase:
    """The stored showcase of a folder, built once for an application, as the nightly run does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _opened:
        path = shared_path(spark, "showcase")
        showcase.store(kept(spark, sf_dir, "shown", lambda: shown(spark, sf_dir)), path)
        _opened[key] = showcase.open_showcase(spark, path)
    return _opened[key]


CARDS = f"""{ESTIMATES},
  c_models AS (SELECT model_id, {", ".join(f"CAST(round_even(quantile_cont({c}, 0.5), 0) AS INTEGER) AS m_{c}" for c in ("cc", "co2", "power_hp"))} FROM detailed GROUP BY model_id),
  c_versions AS (SELECT DISTINCT 'v' || (order_id % 100) AS version_id, order_id % 100 AS k FROM detailed WHERE order_id % 4 = 0),
  c_joined AS (SELECT d.* EXCLUDE (version, facts), e.transport, e.isv, e.iuc, e.total_pt, e.home_price, e.sample_size, e.confidence, e.savings, e.savings_pct, e.verdict, m_cc, m_co2, m_power_hp,
    CASE WHEN match_confidence = 'exato' THEN k END AS k, CASE WHEN d.match_confidence = 'designacao' THEN d.facts END AS f, coalesce(k % 10, CASE WHEN d.facts IS NOT NULL THEN d.order_id % 10 END) AS c, s_name, d.year >= 2019 AS wltp
    FROM detailed d JOIN (SELECT id, transport, isv, iuc, total_pt, home_price, sample_size, confidence, savings, savings_pct, verdict FROM estimates) e USING (id) JOIN c_models USING (model_id) LEFT JOIN c_versions USING (version_id)
    LEFT JOIN (SELECT s_name FROM supplier WHERE s_suppkey % 5 <> 0) s ON s_name = d.seller),
  c_filled AS (SELECT *, 1300 + k % 7 * 100 AS k_cc, CASE WHEN wltp THEN 110 + k WHEN k % 3 <> 0 THEN 95 + k END AS k_co2, 100 + k AS k_power, CASE WHEN wltp THEN f.co2_wltp ELSE f.co2_nedc END AS f_co2,
    CASE WHEN order_id % 9 <> 0 THEN make END AS make_raw, split_part(model_id, '|', 1) AS model_raw, CASE WHEN order_id % 4 <> 3 THEN title END AS variant FROM c_joined),
  cards AS (SELECT id, country, model_id, price, match_confidence, deleted_at, observed_at, year, km, fuel, CASE order_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' END AS gearbox,
    CAST(coalesce(cc, k_cc, f.cc, m_cc) AS INTEGER) AS displacement, CASE WHEN cc IS NOT NULL THEN 'listing' WHEN k IS NOT NULL THEN 'version' WHEN f.cc IS NOT NULL THEN 'facts' ELSE 'model' END AS displacement_from,
    CAST(coalesce(co2, k_co2, f_co2, m_co2) AS INTEGER) AS co2, CASE WHEN co2 IS NOT NULL THEN 'listing' WHEN k_co2 IS NOT NULL THEN 'version' WHEN f_co2 IS NOT NULL THEN 'facts' ELSE 'model' END AS co2_from,
    CAST(coalesce(power_hp, k_power, f.power, m_power_hp) AS INTEGER) AS power, CASE WHEN power_hp IS NOT NULL THEN 'listing' WHEN k IS NOT NULL THEN 'version' WHEN f IS NOT NULL THEN 'facts' ELSE 'model' END AS power_from,
    CASE WHEN k IS NOT NULL THEN 'Catalog ' || c || ' ' || CASE WHEN k % 8 = 0 THEN '8 Series ' ELSE 'Plain ' END || k WHEN f IS NOT NULL THEN 'Catalog ' || c || ' Model ' || c || ' ' || f.power || ' cv'
      ELSE concat_ws(' ', make_raw, coalesce(variant, model_raw)) END AS title,
    coalesce('Site ' || s_name, 'site-' || lower(country)) AS source, CASE WHEN order_id % 2 = 0 THEN 'https://img.example/' || order_id || '/640x480.webp' END AS photo,
    CASE WHEN k IS NOT NULL THEN CASE WHEN k % 16 = 0 THEN 'https://v.example/' || k WHEN c % 3 <> 0 THEN 'https://m.example/' || c END WHEN f IS NOT NULL AND c % 3 <> 0 THEN 'https://m.example/' || c END AS catalog_image,
    total_pt, home_price, confidence, savings, savings_pct, verdict, coalesce(make_raw, 'Make') AS make_shown, concat_ws(' ', 'Catalog ' || c, 'Model ' || c || ' (W212)', CASE WHEN k % 8 = 0 THEN 'G16 G15 8 Series ' || k ELSE 'Plain ' || k END, make_raw, model_raw, variant) AS searched FROM c_filled),
  montra AS (SELECT * FROM cards WHERE deleted_at IS NULL AND match_confidence = 'exato' AND confidence = 'normal'
    QUALIFY row_number() OVER (PARTITION BY model_id, year, CAST(round(km / 1000.0) * 1000 AS BIGINT), price ORDER BY savings DESC, id) = 1)"""
SHOWN = ["id", "title", "country", "year", "km", "price", "total_pt", "savings", "savings_pct", "verdict"]
SHOWN_SQL = ", ".join(SHOWN)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("title", F.col("title.value")).select(*SHOWN)


@query(f"""WITH {CARDS} SELECT id, title, displacement, displacement_from, co2, co2_from, power, power_from, fuel, gearbox, source, photo, catalog_image, verdict FROM cards""")
def showcase_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with an estimate as a card, each field with the source that filled it."""
    rows = cards(spark, sf_dir)
    both = [x for c in ("displacement", "co2", "power") for x in (F.col(f"{c}.value").cast("int").alias(c), F.col(f"{c}.origin").alias(f"{c}_from"))]
    return rows.select("id", F.col("title.value").alias("title"), *both, F.col("fuel.value").alias("fuel"), "gearbox", "source", "photo", "catalog_image", "verdict")


def _pages(name: str, sql: str, given: str, doc: str) -> None:
    """Register a page of the showcase under ``name``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(showcase.page(opened(spark, sf_dir), Filters.parse(given)))

    run.__name__, run.__doc__ = name, doc
    query(f"WITH {CARDS} SELECT {SHOWN_SQL} FROM montra {sql}")(run)


_pages("showcase_page", "ORDER BY savings_pct DESC NULLS FIRST, id LIMIT 24", "", "The first page, by rank: it reads the first slots only.")
_pages("showcase_page_3", "ORDER BY savings_pct DESC NULLS FIRST, id LIMIT 24 OFFSET 48", "page=3", "A later page by rank.")
_pages("showcase_recent", "ORDER BY observed_at DESC NULLS FIRST, id LIMIT 24", "sort=recent", "What was seen last.")
_pages("showcase_cheapest", "WHERE verdict = 'compensa' ORDER BY total_pt, id LIMIT 24", "verdict=compensa&sort=price", "Worthwhile ones, the cheapest landed first.")
FACETS = "country=DE,FR&maxTotal=30000&minYear=2016&maxKm=120000&fuel=diesel&gearbox=manual&sort=savings"
FACETS_SQL = "country IN ('DE', 'FR') AND total_pt <= 30000 AND year >= 2016 AND km <= 120000 AND fuel = 'diesel' AND gearbox = 'manual'"
_pages("showcase_faceted", f"WHERE {FACETS_SQL} ORDER BY savings DESC NULLS FIRST, id LIMIT 24", FACETS, "A page under all facets; unknown gearboxes fit none.")
_pages("showcase_words", "WHERE contains(lower(searched), 'series') AND contains(lower(searched), '8') AND contains(lower(searched), 'small') ORDER BY savings_pct DESC NULLS FIRST, id LIMIT 24", "q=small 8 SERIES", "Every word somewhere in the six texts of a card.")


@query(f"WITH {CARDS} SELECT count(*) AS total FROM montra WHERE {FACETS_SQL}")
def showcase_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cards the facets leave."""
    return showcase.total(opened(spark, sf_dir), Filters.parse(FACETS))


@query(f"WITH {CARDS} SELECT count(*) AS offers, count(*) FILTER (verdict = 'compensa') AS worthwhile, count(*) FILTER (observed_at > {NOW} - INTERVAL 7 DAY) AS fresh, coalesce(CAST(round_even(quantile_cont(savings, 0.5) FILTER (verdict = 'compensa'), 0) AS INTEGER), 0) AS median_savings, max(savings) AS best FROM montra")
def showcase_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the dashboard over the stored showcase."""
    worthwhile = F.col("verdict") == "compensa"
    fresh = F.count_if(F.col("last_seen_at") > F.expr(f"{NOW} - interval 7 days"))
    median = F.coalesce(half_even_int(F.percentile(F.when(worthwhile, F.col("savings")), F.lit(0.5))), F.lit(0))
    return opened(spark, sf_dir).rows.agg(F.count("*").alias("offers"), F.count_if(worthwhile).alias("worthwhile"), fresh.alias("fresh"), median.alias("median_savings"), F.max("savings").alias("best"))


ALERTS = """asked_alerts AS (SELECT c_custkey AS alert_id, c_nationkey AS stand_id, c_custkey % 13 <> 0 AS active, CASE WHEN c_custkey % 11 <> 0 THEN 'brand-' || (c_custkey % 25 + 1) END AS make_key,
    lower(['ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO', 'STANDARD'][c_custkey % 6 + 1]) AS model_key, CASE WHEN c_custkey % 5 <> 0 THEN 20000 + c_custkey % 7000 END AS max_price,
    CASE WHEN c_custkey % 4 = 0 THEN [] ELSE [['DE', 'FR', 'BE', 'NL', 'ES'][c_custkey % 5 + 1]] END AS countries FROM customer)"""
MATCHES = f"""{CARDS}, {ALERTS}, matches AS (SELECT alert_id, stand_id, id, country, total_pt, savings, observed_at AS seen_at FROM asked_alerts JOIN montra ON make_key = lower(replace(make_shown, '#', '-')) AND model_key = lower(split_part(model_id, '|', 1))
    WHERE active AND verdict = 'compensa' AND (max_price IS NULL OR total_pt <= max_price) AND (len(countries) = 0 OR list_contains(countries, country)))"""


def watching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for every customer: a third of them with raw makes and models, some without a model, some not active, some without countries or a highest price."""
    k = F.col("c_custkey")
    old = k % 3 == 0
    make, family = F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")), _pick(["ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD"], k % 6)
    known = k % 11 != 0
    raw = table(spark, sf_dir, "customer").select(
        k.alias("alert_id"), F.col("c_nationkey").alias("stand_id"), (k % 13 != 0).alias("active"), F.when(known & ~old, F.concat(F.lit("brand-"), (k % 25 + 1).cast("string"))).alias("make_key"), F.when(~old, F.lower(family)).alias("model_key"),
        F.when(known & old, F.upper(make)).alias("make"), F.concat(family, F.lit(" VII")).alias("model"), F.when(k % 5 != 0, k % 7000 + 20000).alias("max_price"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(["DE", "FR", "BE", "NL", "ES"], k % 5))).alias("countries"),
    )
    return alerts.watched(raw)


#: Up to so many shown offers, those worthwhile are sent to all tasks.
SENT_OFFERS = 250_000


def _worthwhile(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.lower(F.split_part("model_id", F.lit("|"), F.lit(1)))
    shown = opened(spark, sf_dir)
    rows = shown.rows.where("verdict = 'compensa'").select("id", norm_make(F.col("make")).alias("make_key"), family.alias("model_key"), "country", "total_pt", "savings", F.col("last_seen_at").alias("seen_at"))
    return F.broadcast(rows) if sum(n for _, n in shown.slots) <= SENT_OFFERS else rows


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asking = alerts.dealt(watching(spark, sf_dir), table(spark, sf_dir, "customer").count())  # from the file's footer
    return alerts.matches(asking, _worthwhile(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT alert_id, id FROM matches WHERE (alert_id + total_pt) % 3 <> 0")
def alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new for every alert, where some of its matches have been told before."""
    found = _matches(spark, sf_dir)
    told = found.where((F.col("alert_id") + F.col("total_pt")) % 3 == 0)
    return alerts.new_matches(found, told).select("alert_id", "id")


@query(f"WITH {MATCHES} SELECT alert_id, count(id) AS n, max(seen_at) AS last_match FROM asked_alerts LEFT JOIN matches USING (alert_id) GROUP BY alert_id")
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many opportunities fit each alert, and when the last of them was seen."""
    counted = alerts.match_counts(watching(spark, sf_dir), _worthwhile(spark, sf_dir))
    return watching(spark, sf_dir).select("alert_id").join(counted, "alert_id", "left").select("alert_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "last_match")


@query(f"WITH {MATCHES} SELECT stand_id, alert_id, id, savings FROM matches QUALIFY row_number() OVER (PARTITION BY stand_id ORDER BY seen_at DESC, id, alert_id) <= 8")
def notifications_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.notifications(_matches(spark, sf_dir)).select("stand_id", "alert_id", "id", "savings")


@query(f"WITH {MATCHES} SELECT alert_id, id, s_suppkey AS user_id, s_name AS owner_name FROM matches JOIN supplier ON s_nationkey = stand_id AND s_suppkey % 4 = 0")
def alert_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with the owners of its stand."""
    supplier = table(spark, sf_dir, "supplier")
    members = supplier.select(F.col("s_nationkey").alias("stand_id"), F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 4 == 0, "owner").otherwise("member").alias("role"))
    users = supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"), F.lit("x@y.example").alias("email"))
    return alerts.with_owners(_matches(spark, sf_dir), members, users).select("alert_id", "id", "user_id", "owner_name")
