"""Queries of the write side: histories, merges, publishing, catalog and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.operators import catalog, upkeep
from motorlake.plans.registry import query
from motorlake.sources.tables import LISTINGS_SQL, listings, table

SEEN = "seen AS (SELECT l_partkey AS part, l_suppkey AS supplier, l_orderkey, l_linenumber, l_shipdate AS seen_at, CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(l_quantity AS INTEGER) AS km FROM lineitem)"
ORDER = ["seen_at", "l_orderkey", "l_linenumber", "price"]


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations of (part, supplier)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("seen_at"), F.round("l_extendedprice").cast("bigint").alias("price"), F.col("l_quantity").cast("int").alias("km"))


@query(f"WITH {SEEN} SELECT part, seen_at, price FROM (SELECT *, lag(price) OVER (PARTITION BY part ORDER BY seen_at, l_orderkey, l_linenumber, price) AS before FROM seen) WHERE price IS DISTINCT FROM before")
def price_change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.price_changes(seen(spark, sf_dir), "part", "price", ORDER).select("part", "seen_at", "price")


LAST = "SELECT part, supplier, price, km, seen_at FROM seen WHERE seen_at {} TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY part ORDER BY seen_at DESC, l_orderkey DESC, l_linenumber DESC, price DESC) = 1"


def _last(rows: DataFrame) -> DataFrame:
    return upkeep.latest(rows, ["part"], ORDER).select("part", "supplier", "price", "km", "seen_at")


@query(
    f"WITH {SEEN}, old AS ({LAST.format('<')}), new AS (SELECT part, supplier, CASE WHEN price % 3 = 0 THEN NULL ELSE price END AS price, km, seen_at FROM ({LAST.format('>=')})) SELECT part, CASE WHEN old.part IS NULL THEN new.supplier ELSE old.supplier END AS supplier, coalesce(new.price, old.price) AS price, coalesce(new.km, old.km) AS km, greatest(old.seen_at, new.seen_at) AS seen_at FROM old FULL JOIN new USING (part)"
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old observations after newer ones, some without a price; the supplier is only inserted."""
    rows = seen(spark, sf_dir)
    old = _last(rows.where("seen_at < timestamp_ntz'1998-01-01'"))
    new = _last(rows.where("seen_at >= timestamp_ntz'1998-01-01'")).withColumn("price", F.when(F.col("price") % 3 != 0, F.col("price")))
    return upkeep.upsert(old, new, ["part"], ["price", "km"], seen="seen_at")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 5 = 0 OR p_size % 3 = 0) THEN 24000 ELSE coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 22000 ELSE 23000 END, 24000) END AS price FROM part")
def cash_price_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24000 was verified while 22000 was advertised; the feed says nothing, 22000 or 23000."""
    new = F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("int")).when(F.col("p_size") % 3 == 0, 22000).otherwise(23000)
    return table(spark, sf_dir, "part").select("p_partkey", upkeep.kept_cash_price(F.lit(24000), F.lit(22000), new, F.col("p_partkey") % 2 == 0).alias("price"))


@query(f"WITH {SEEN}, last AS (SELECT part, max(seen_at) AS last_seen FROM seen GROUP BY part) SELECT part, last_seen, last_seen < (SELECT max(seen_at) FROM seen) - INTERVAL 14 DAY AS deleted FROM last")
def stale_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seen(spark, sf_dir)
    now = rows.agg(F.max("seen_at").alias("now"))
    last = rows.groupBy("part").agg(F.max("seen_at").alias("last_seen")).crossJoin(F.broadcast(now)).withColumn("deleted_at", F.lit(None).cast(rows.schema["seen_at"].dataType))  # one row
    return upkeep.stale(last, F.col("now")).select("part", "last_seen", F.col("deleted_at").isNotNull().alias("deleted"))


TARGET = "target AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)"


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The source leaves out every 13th part; the target has other sizes for every 7th and lacks every 11th."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return parts.where("p_partkey % 13 <> 0"), parts.where("p_partkey % 11 <> 0").withColumn("p_size", size)


@query(f"WITH {TARGET}, source AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 13 <> 0) SELECT p_partkey, CASE WHEN t.p_name IS NULL THEN 'insert' WHEN s.p_name IS NULL THEN 'stray' WHEN s.p_size <> t.p_size THEN 'update' ELSE 'keep' END AS action FROM source s FULL JOIN target t USING (p_partkey)")
def publish_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.changes(*_published(spark, sf_dir), ["p_partkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'untouched' WHEN p_size > 25 THEN 'demote' ELSE 'soft_delete' END AS action FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 11 <> 0")
def publish_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    strays = upkeep.changes(*_published(spark, sf_dir), ["p_partkey"]).where("action = 'stray'").drop("action")
    corpus = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") > 25).alias("alive"))
    return upkeep.stray_actions(strays, corpus, ["p_partkey"])


@query("SELECT o_orderkey, o_custkey + 1000000 AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 0")
def surrogate_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the target's customer ids, found through the customer's name; some customers are unknown there."""
    customers = table(spark, sf_dir, "customer")
    target = customers.where("c_custkey % 10 <> 0").select((F.col("c_custkey") + 1000000).alias("id"), "c_name")
    return upkeep.remap(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers.select(F.col("c_custkey").alias("id"), "c_name"), target, "o_custkey", ["c_name"])


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND CAST(o_orderdate AS DATE) = CAST(l_shipdate AS DATE))")
def same_day_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_day"))
    return lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("ship_day") == F.col("day")), "left_anti").drop("ship_day")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def catalog_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key wins."""
    return upkeep.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "WITH starts AS (SELECT DISTINCT p_brand AS family, 2000 + p_size AS start FROM part WHERE p_size % 5 <> 0 AND p_partkey % 3 = 0), marked AS (SELECT *, CASE WHEN lag(start) OVER w IS NULL OR start - lag(start) OVER w >= 2 THEN 1 ELSE 0 END AS fresh FROM starts WINDOW w AS (PARTITION BY family ORDER BY start)), "
    "numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY family ORDER BY start) - 1 AS generation FROM marked), found AS (SELECT family, generation, min(start) AS first_start, count(*) AS starts FROM numbered GROUP BY ALL) "
    "SELECT family, CAST(generation AS INTEGER) AS generation, starts, CASE WHEN generation = 0 THEN first_start - 1 ELSE first_start END AS year_start, lead(first_start) OVER (PARTITION BY family ORDER BY generation) - 1 AS year_end FROM found"
)
def generation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_size % 5 <> 0 and p_partkey % 3 = 0").select(F.col("p_brand").alias("family"), (F.lit(2000) + F.col("p_size")).alias("start"))
    return upkeep.clusters(rows, "family", "start")


@query(
    "WITH tokens AS (SELECT DISTINCT p_type AS family, p_partkey AS mid, unnest(string_split(p_type || ' ' || p_name, ' ')) AS token FROM part), sizes AS (SELECT family, count(DISTINCT mid) AS n FROM tokens GROUP BY family), core AS (SELECT family, token FROM tokens JOIN sizes USING (family) GROUP BY family, token, n HAVING count(*) = n) SELECT mid, string_agg(token, ' ' ORDER BY token) AS distinctive FROM tokens ANTI JOIN core USING (family, token) GROUP BY mid"
)
def distinctive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), F.col("p_partkey").alias("mid"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("tokens"))
    return catalog.distinctive(parts).select("mid", F.concat_ws(" ", F.sort_array("distinctive")).alias("distinctive"))


@query(
    "SELECT n_name AS source, count(*) AS active, CAST(round(100.0 * count(*) FILTER (s_acctbal > 0) / count(*)) AS INTEGER) AS solvent_pct, CAST(round(100.0 * count(DISTINCT s_suppkey % 7) / 7) AS INTEGER) AS coverage_pct FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 0"
)
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pct = lambda n, of: F.round(F.lit(100.0) * n / of).cast("int")
    counted = rows.groupBy(F.col("n_name").alias("source")).agg(F.count("*").alias("active"), F.count_if(F.col("s_acctbal") > 0).alias("solvent"), F.size(F.collect_set(F.col("s_suppkey") % 7)).alias("covered"))
    return counted.select("source", "active", pct(F.col("solvent"), F.col("active")).alias("solvent_pct"), pct(F.col("covered"), 7).alias("coverage_pct"))


VERSIONS = "versions AS (SELECT p_partkey AS version_id, p_brand AS make, p_type AS family, 2000 + p_size % 20 AS year_start, 2006 + p_size % 20 AS year_end, 90 + (p_partkey % 12) * 15 AS power_hp FROM part)"
ADS = "ads AS (SELECT l_orderkey AS ad, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, p_brand AS make, p_type AS family, 2000 + l_orderkey % 26 AS year, 90 + (l_suppkey % 12) * 15 AS power_hp FROM lineitem JOIN part ON l_partkey = p_partkey)"
TIERS = f"WITH {VERSIONS}, {ADS}, grouped AS (SELECT DISTINCT make, family, year, power_hp FROM ads), counted AS (SELECT g.make, g.family, g.year, g.power_hp, count(version_id) AS candidates, min(version_id) AS version_id FROM grouped g LEFT JOIN versions v ON v.make = g.make AND v.family = g.family AND g.year BETWEEN v.year_start AND v.year_end AND abs(v.power_hp - g.power_hp) <= greatest(7, floor(g.power_hp * 0.04 + 0.5)) GROUP BY ALL)"


def _ads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    versions = parts.select(F.col("p_partkey").alias("version_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("family"), (F.lit(2000) + F.col("p_size") % 20).alias("year_start"), (F.lit(2006) + F.col("p_size") % 20).alias("year_end"), (F.lit(90) + F.col("p_partkey") % 12 * 15).alias("power_hp"))
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("ad"), F.col("p_brand").alias("make"), F.col("p_type").alias("family"), (F.lit(2000) + F.col("l_orderkey") % 26).alias("year"), (F.lit(90) + F.col("l_suppkey") % 12 * 15).alias("power_hp")), versions


@query(f"{TIERS} SELECT make, family, year, power_hp, candidates, CASE WHEN candidates = 1 THEN version_id END AS version_id, CASE WHEN candidates = 1 THEN 'exact' WHEN candidates > 1 THEN 'designation' END AS tier FROM counted")
def tier_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each distinct signal of the ads, and the tier that they allow."""
    ads, versions = _ads(spark, sf_dir)
    return catalog.tiers(ads.select("make", "family", "year", "power_hp").distinct(), versions)


@query(f"{TIERS} SELECT a.make, count(*) FILTER (candidates = 1) AS exact, count(*) FILTER (candidates > 1) AS designation, count(*) FILTER (candidates = 0) AS none FROM ads a JOIN counted USING (make, family, year, power_hp) GROUP BY a.make")
def tier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads, versions = _ads(spark, sf_dir)
    signals = ["make", "family", "year", "power_hp"]
    judged = ads.groupBy(*signals).agg(F.count("*").alias("n")).join(catalog.tiers(ads.select(*signals).distinct(), versions), signals)
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint"))
    return judged.groupBy("make").agg(part(F.col("tier") == "exact").alias("exact"), part(F.col("tier") == "designation").alias("designation"), part(F.col("tier").isNull()).alias("none"))


@query(f"{TIERS} SELECT a.make, a.family, count(*) AS n FROM ads a JOIN counted USING (make, family, year, power_hp) WHERE candidates = 0 GROUP BY ALL ORDER BY n DESC, a.make, a.family LIMIT 20")
def unmapped_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads, versions = _ads(spark, sf_dir)
    signals = ["make", "family", "year", "power_hp"]
    judged = ads.groupBy(*signals).agg(F.count("*").alias("n")).join(catalog.tiers(ads.select(*signals).distinct(), versions), signals)
    return judged.where("tier is null").groupBy("make", "family").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "make", "family").limit(20)


@query(f"WITH {LISTINGS_SQL} SELECT id FROM listings WHERE NOT coalesce(country <> 'PT' AND km > 6000 AND price > 0, false)")
def orphan_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that may have no estimate: the complement of the eligible ones, unknown included."""
    eligible = F.coalesce((F.col("country") != "PT") & (F.col("km") > 6000) & (F.col("price") > 0), F.lit(False))
    return listings(spark, sf_dir).where(~eligible).select("id")


@query(
    """SELECT p_partkey, 22000 + p_size AS price, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN 21000 END AS cash,
    CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN 'yes' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'new' END END AS checked FROM part"""
)
def verified_fields_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after newer ones: the marks of a verified cash price stay on even parts, those of them that are known; every seventh part is new."""
    key = F.col("p_partkey")
    old = F.when(key % 7 != 0, F.struct(F.lit(20000).alias("price"), F.lit(21000).alias("cash"), F.when(key % 5 != 0, "yes").alias("checked")))
    new = F.struct((F.lit(22000) + F.col("p_size")).alias("price"), F.lit(None).cast("int").alias("cash"), F.when(key % 3 == 0, "new").alias("checked"))
    merged = upkeep.kept_fields(F.col("old"), F.col("new"), ["price", "cash", "checked"], ["cash", "checked"], key % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", old.alias("old"), new.alias("new")).select("p_partkey", merged.alias("m")).select("p_partkey", "m.*")


@query(
    """WITH counted AS (SELECT n_regionkey AS region, count(*) AS nations, min(n_name) FILTER (n_regionkey <> 2) AS first FROM nation GROUP BY 1)
    SELECT sha256(string_agg('{"first":' || coalesce('"' || first || '"', 'null') || ',"nations":' || nations || ',"region":' || region || '}', chr(10) ORDER BY region)) AS digest FROM counted"""
)
def report_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a report's snapshot, which only other rows can change."""
    report = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"), F.min(F.when(F.col("n_regionkey") != 2, F.col("n_name"))).alias("first"))
    lines = upkeep.snapshot(report, ["region"]).withColumn("place", F.monotonically_increasing_id())
    # A snapshot is a report of a few rows: here one for each region.
    listed = lines.agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return listed.select(F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("digest"))


@query("SELECT p_partkey || chr(9) || p_name || chr(9) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a b' END || chr(9) || p_size AS line FROM part")
def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's audit as tab-separated text."""
    rows = table(spark, sf_dir, "part").withColumn("note", F.when(F.col("p_partkey") % 3 != 0, "a\tb"))
    return upkeep.tab_separated(rows, ["p_partkey", "p_name", "note", "p_size"])


@query(
    """WITH matches AS (SELECT o_orderkey AS match_id, 'c' || o_custkey || '@example.com' AS recipient, o_orderpriority AS alert, CASE WHEN o_orderkey % 4 = 0 THEN 'Anúncio' WHEN o_orderkey % 4 = 1 THEN 'Make ' || year(o_orderdate) ELSE 'Make Model ' || year(o_orderdate) END AS title, o_orderkey AS listing FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT match_id, recipient, alert, title, 'Apareceu um ' || title || ' que encaixa no teu alerta' AS subject, 'https://site.example/anuncio/' || listing AS address FROM matches"""
)
def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails of order matches that weren't sent yet; every fifth was, twice."""
    orders = table(spark, sf_dir, "orders")
    key, unnamed = F.col("o_orderkey"), F.col("o_orderkey") % 4 == 0
    matches = orders.select(
        key.alias("match_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"), F.col("o_orderpriority").alias("alert"),
        F.when(~unnamed, "Make").alias("make"), F.when(key % 4 == 1, "").when(~unnamed, "Model").alias("model"), F.when(~unnamed, F.year("o_orderdate")).alias("year"), key.alias("listing_id"),
    )
    sent = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("match_id"))
    return upkeep.outbox(matches, sent.unionAll(sent), "https://site.example")
