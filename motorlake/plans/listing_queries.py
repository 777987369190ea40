"""Queries over the fields of listings, the feeds they come from, alerts, subscriptions and the landing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlake.functions import listing
from motorlake.functions.identity import fallback_identity
from motorlake.operators import feeds, search
from motorlake.plans.registry import query
from motorlake.plans.search_queries import SHOWCASE, offers, showcase
from motorlake.session import shared_path, stored
from motorlake.sources import ndjson
from motorlake.sources.tables import DETAILED_SQL, LISTINGS_SQL, detailed, listings, table

#: What tells vehicles apart.
VEHICLE = ["model_id", "year", "km", "price"]
SEGMENTS = "list_filter(string_split(regexp_extract(detail_url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '/'), lambda s: s <> '')"


@query(
    f"""WITH {DETAILED_SQL}, cut AS (SELECT id, regexp_replace(regexp_extract(detail_url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '[/_.+-]', ' ', 'g') AS words, list_transform({SEGMENTS}, lambda s: regexp_replace(s, '(?i)\\.[a-z0-9]+$', '')) AS segments FROM detailed),
    ranked AS (SELECT id, words, list_max(list_transform(segments, lambda s, i: {{'hyphens': length(s) - length(replace(s, '-', '')), 'place': i, 'text': s}})) AS best FROM cut)
    SELECT id, words, CASE WHEN best.hyphens >= 2 THEN best.text END AS title FROM ranked"""
)
def address_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each listing's address, and the title that its seller wrote there."""
    url = F.col("detail_url")
    return detailed(listings(spark, sf_dir)).select("id", listing.path_text(url).alias("words"), listing.seller_title(url).alias("title"))


@query(
    f"""WITH {LISTINGS_SQL}, said AS (SELECT id, CASE order_id % 4 WHEN 0 THEN 'ano 2018 ' || km // 1000 || '.000 km' WHEN 1 THEN km || 'Km, bom estado' WHEN 2 THEN 'mais de 40202370 km' ELSE title END AS said FROM listings),
    found AS (SELECT id, TRY_CAST(regexp_replace(regexp_extract(said, '(?i)\\b(\\d{{1,3}}(?:[.\\s]\\d{{3}})+|\\d{{3,7}})\\s*km\\b', 1), '[.\\s]', '', 'g') AS BIGINT) AS km FROM said)
    SELECT id, CASE WHEN km BETWEEN 1 AND 2000000 THEN km END AS km FROM found"""
)
def km_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, km = F.col("order_id"), F.col("km")
    said = F.when(o % 4 == 0, F.concat(F.lit("ano 2018 "), F.floor(km / 1000).cast("string"), F.lit(".000 km"))).when(o % 4 == 1, F.concat(km.cast("string"), F.lit("Km, bom estado"))).when(o % 4 == 2, "mais de 40202370 km").otherwise(F.col("title"))
    return listings(spark, sf_dir).select("id", listing.km_in_text(said).alias("km"))


BRANDS_SQL = "brands AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS brand FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 3 = 0)"


@query(f"WITH {BRANDS_SQL} SELECT p_partkey, (SELECT max_by(brand, length(brand)) FROM brands WHERE lower(p_name) = lower(brand) OR starts_with(lower(p_name), lower(brand) || ' ') OR starts_with(lower(p_name), lower(brand) || '-')) AS brand FROM part")
def brand_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest brand that a title starts with."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    brands = part.select(word(1).alias("brand")).union(part.where("p_partkey % 3 = 0").select(F.concat_ws(" ", word(1), word(2)))).distinct()
    return feeds.longest_prefix(part, brands, "p_name", "brand", "p_partkey").select("p_partkey", "brand")


@query(
    """WITH names AS (SELECT p_partkey, lower(p_brand) AS make, replace(lower(p_type), ' ', '-') AS model, p_name || ' (' || p_size || ')' AS catalog_name, 'G' || p_size || ' W213 ' || p_name AS version,
      CASE WHEN p_partkey % 3 = 0 THEN '/relative/1.webp' ELSE 'https://img.example/' || p_partkey || '/250x188.webp' END AS image FROM part)
    SELECT p_partkey, CASE WHEN length(make) <= 3 THEN upper(make) ELSE upper(make[1:1]) || make[2:] END || ' ' || list_reduce(list_transform(string_split(model, '-'), lambda s: upper(s[1:1]) || s[2:]), lambda a, b: a || '-' || b) AS label,
      trim(regexp_replace(catalog_name, '\\s*\\([^)]*\\)', '', 'g')) AS model, coalesce(nullif(trim(regexp_replace(version, '^(?:[A-Za-z]{1,2}\\d{1,3}[A-Za-z]?\\s+)+', '')), ''), version) AS version,
      CASE WHEN starts_with(image, 'https://') THEN regexp_replace(image, '/250x188\\.webp$', '/640x480.webp') END AS photo FROM names"""
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of families, cleaned catalog names and photos."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    image = F.when(F.col("p_partkey") % 3 == 0, "/relative/1.webp").otherwise(F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string"), F.lit("/250x188.webp")))
    return part.select(
        "p_partkey",
        listing.family_label(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("#")), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))).alias("label"),
        listing.clean_model(F.concat("p_name", F.lit(" ("), size, F.lit(")"))).alias("model"),
        listing.clean_version(F.concat(F.lit("G"), size, F.lit(" W213 "), F.col("p_name"))).alias("version"),
        listing.photo(image).alias("photo"),
    )


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN date_trunc('second', ts) END AS created FROM events")
def created_from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of creation that an id begins with."""
    events = table(spark, sf_dir, "events")
    identifier = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("2413"), F.col("event_id").cast("string"), F.lit("99999999"))).otherwise(F.concat(F.date_format("ts", "yyMMddHHmmss"), F.lit("4900")))
    return events.select("event_id", listing.created_at(identifier).cast("timestamp_ntz").alias("created"))


@query(
    """WITH states AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'trial' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'cancelada' ELSE 'ativa' END WHEN 'error' THEN 'em_atraso' WHEN 'signup' THEN 'expirada' END AS state FROM events),
    last AS (SELECT user_id, max_by(state, (ts, event_id)) AS state, max(ts) + INTERVAL 20 DAY AS period_end FROM states WHERE state IS NOT NULL GROUP BY user_id),
    now AS (SELECT *, CASE WHEN state = 'expirada' OR period_end <= TIMESTAMP '2024-02-18' THEN 'expirada' ELSE state END AS effective FROM last)
    SELECT user_id, state, effective, effective <> 'expirada' AS access FROM now"""
)
def subscription_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known state of each stand's subscription, and what holds now; unknown states are left out."""
    kinds = F.create_map(*[F.lit(x) for pair in {"view": "trialing", "purchase": "active", "error": "past_due", "signup": "incomplete"}.items() for x in pair])
    state = listing.subscription_status(F.try_element_at(kinds, F.col("event_type")), F.col("event_id") % 2 == 0)
    events = table(spark, sf_dir, "events").withColumn("state", state).where("state is not null")
    last = events.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.timestamp_add("DAY", F.lit(20), F.max("ts")).alias("period_end"))
    effective = listing.effective_status(F.col("state"), F.col("period_end"), F.expr("TIMESTAMP '2024-02-18'"))
    return last.select("user_id", "state", effective.alias("effective"), listing.has_access(effective).alias("access"))


@query(
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'inexistente' WHEN event_id % 7 = 1 THEN 'aceite' WHEN event_id % 7 = 2 THEN 'cancelado' WHEN ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' THEN 'expirado' ELSE 'pendente' END AS state FROM events) GROUP BY state"""
)
def invite_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 1, "accepted").when(F.col("event_id") % 7 == 2, "revoked").when(F.col("event_id") % 7 != 0, "pending")
    state = listing.invite_state(status, F.timestamp_add("DAY", F.lit(7), F.col("ts")), F.expr("TIMESTAMP '2024-01-20'"))
    return table(spark, sf_dir, "events").select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (k IS NOT NULL AND event_id % 11 <> 0) AS valid, CAST(sum(k) FILTER (event_id % 11 <> 0) AS BIGINT) AS total FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def webhook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes by kind: those that hold what they have to, and the sum of it."""
    body = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    read = F.from_json(body, T.StructType([T.StructField("k", T.LongType())]))
    return table(spark, sf_dir, "events").withColumn("k", read["k"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("valid"), F.sum("k").alias("total"))


@query(f"WITH {LISTINGS_SQL} SELECT country, fuel, count(*) AS n, count(DISTINCT seller) AS sellers, min(price) AS least, max(price) AS most, CAST(sum(price) AS BIGINT) AS total, CAST(round_even(avg(price), 0) AS BIGINT) AS mean FROM listings GROUP BY country, fuel")
def crawl_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy("country", "fuel").agg(F.count("*").alias("n"), F.countDistinct("seller").alias("sellers"), F.min("price").alias("least"), F.max("price").alias("most"), F.sum("price").cast("bigint").alias("total"), F.rint(F.avg("price")).cast("bigint").alias("mean"))


@query(f"WITH {DETAILED_SQL} SELECT seller, count(*) AS unknown FROM detailed WHERE match_confidence IS NULL AND deleted_at IS NULL GROUP BY seller")
def unknown_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(listings(spark, sf_dir)).where("match_confidence is null and deleted_at is null").groupBy("seller").agg(F.count("*").alias("unknown"))


@query(f"WITH {SHOWCASE} SELECT id, savings_pct, place FROM (SELECT id, savings_pct, CAST(row_number() OVER (ORDER BY savings_pct DESC, id) AS INTEGER) AS place FROM offers WHERE country = 'ES' AND verdict = 'compensa' ORDER BY savings_pct DESC, id LIMIT 50)")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty listings of one market that are worth a closer look first."""
    top = offers(spark, sf_dir).where("country = 'ES' and verdict = 'compensa'").orderBy(F.col("savings_pct").desc(), "id").limit(50)
    return top.select("id", "savings_pct", F.row_number().over(Window.orderBy(F.col("savings_pct").desc(), "id")).alias("place"))  # fifty rows


@query(f"WITH {SHOWCASE} SELECT id, share FROM (SELECT id, isv / total_home AS share, km >= 20000 AS used, isv FROM showcase) WHERE isv > 0 ORDER BY used DESC, share DESC, id LIMIT 1")
def tax_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The used car with the largest share of tax, or any taxed one where no used car is."""
    rows = showcase(spark, sf_dir).where("isv > 0").withColumn("share", F.col("isv") / F.col("total_home"))
    return rows.orderBy((F.col("km") >= 20000).desc(), F.col("share").desc(), "id").limit(1).select("id", "share")


@query(f"WITH {SHOWCASE}, four AS (SELECT * FROM offers ORDER BY price DESC, id LIMIT 4) SELECT id, savings, savings = max(savings) OVER () AS best FROM four")
def compare_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four offers side by side, the best savings marked."""
    four = offers(spark, sf_dir).orderBy(F.col("price").desc(), "id").limit(4)
    return four.select("id", "savings", (F.col("savings") == F.max("savings").over(Window.partitionBy())).alias("best"))  # four rows


@query(f"WITH {SHOWCASE} SELECT id, floor((total_home - price) * 1000.0::DOUBLE / total_home + 0.5) / 10.0::DOUBLE AS extras_pct, floor(least(home_price * 100.0::DOUBLE / total_home, 100) + 0.5) AS reference_bar FROM showcase")
def cost_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of what comes on top of the price, and the length of the bar of the home price."""
    extras = F.floor((F.col("total_home") - F.col("price")) * 1000.0 / F.col("total_home") + 0.5) / 10.0
    return showcase(spark, sf_dir).select("id", extras.alias("extras_pct"), F.floor(F.least(F.col("home_price") * 100.0 / F.col("total_home"), F.lit(100.0)) + 0.5).cast("double").alias("reference_bar"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN d <= 0 THEN 'hoje' WHEN d = 1 THEN 'ontem' ELSE 'há ' || d || ' dias' END AS label FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-25') AS d FROM events)) GROUP BY label")
def freshness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(listing.freshness(F.col("ts"), F.expr("TIMESTAMP '2024-01-25'")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SHOWCASE}, versions AS (SELECT DISTINCT model_id, 'm-' || length(model_id) AS mid FROM listings WHERE order_id % 2 = 0), models AS (SELECT DISTINCT 'm-' || length(model_id) AS mid, 'Model ' || length(model_id) AS catalog_name FROM listings)
    SELECT s.id, s.savings_pct, coalesce(v.mid, CASE WHEN s.order_id % 3 = 0 THEN 'm-20' END) AS mid, m.catalog_name, p.s_acctbal AS source_balance, f.order_id IS NOT NULL AS favourite
    FROM showcase s LEFT JOIN versions v ON v.model_id = s.model_id AND s.order_id % 5 <> 0 LEFT JOIN models m ON m.mid = coalesce(v.mid, CASE WHEN s.order_id % 3 = 0 THEN 'm-20' END) LEFT JOIN supplier p ON p.s_name = s.seller
    LEFT JOIN (SELECT DISTINCT o_orderkey AS order_id FROM orders WHERE o_custkey % 10 = 3) f ON f.order_id = s.order_id"""
)
def showcase_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The showcase with version, catalog model, source and the favourites of one tenant; small sides are joined as Spark sees fit."""
    rows = showcase(spark, sf_dir)
    all_ = listings(spark, sf_dir).select("model_id", "order_id")
    mid = F.concat(F.lit("m-"), F.length("model_id").cast("string"))
    versions = all_.where("order_id % 2 = 0").select(F.col("model_id").alias("v_model"), mid.alias("v_mid")).distinct()
    models = all_.select(mid.alias("m_mid"), F.concat(F.lit("Model "), F.length("model_id").cast("string")).alias("catalog_name")).distinct()
    sources = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.col("s_acctbal").alias("source_balance"))
    liked = table(spark, sf_dir, "orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("liked")).distinct()
    joined = rows.join(versions, (F.col("v_model") == F.col("model_id")) & (F.col("order_id") % 5 != 0), "left").withColumn("mid", F.coalesce("v_mid", F.when(F.col("order_id") % 3 == 0, "m-20")))
    joined = joined.join(models, F.col("m_mid") == F.col("mid"), "left").join(sources, F.col("source") == F.col("seller"), "left").join(liked, F.col("liked") == F.col("order_id"), "left")
    return joined.select("id", "savings_pct", "mid", "catalog_name", "source_balance", F.col("liked").isNotNull().alias("favourite"))


@query(f"WITH {SHOWCASE} SELECT id FROM offers WHERE savings_pct >= 5 AND id NOT IN (SELECT id FROM showcase WHERE verdict = 'compensa')")
def no_longer_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers once flagged, at a lower mark, that aren't among the worthwhile ones of today."""
    kept = stored(offers(spark, sf_dir).where("savings_pct >= 5").select("id", *VEHICLE, "savings_pct", "verdict"), "offers", compression="zstd")
    # a vehicle's best offer is worthwhile only if it is among those at the lower mark, so the showcase of these has the same worthwhile ones
    winners = search.representatives(kept, fallback_identity(*map(F.col, VEHICLE)), kept.count()).where("verdict = 'compensa'")
    return kept.select("id").join(winners.select("id"), "id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, CAST(o_custkey % 7 + 1 AS INTEGER) FROM orders)")
def rows_of_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose two keys are together in a list."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi")


@query(
    f"""WITH {DETAILED_SQL} SELECT 'cars-' || lower(country) AS source, count(*) AS lines, count(*) FILTER (order_id % 13 = 0) AS bad, count(*) FILTER (order_id % 13 <> 0) AS records, count(*) FILTER (order_id % 13 <> 0 AND order_id % 9 = 0) AS price_changes,
    CAST(sum(CASE WHEN order_id % 6 = 0 THEN price - 500 ELSE price END) FILTER (order_id % 13 <> 0) AS BIGINT) AS prices, count(*) FILTER (order_id % 13 <> 0 AND order_id % 3 = 0) AS private FROM detailed GROUP BY country"""
)
def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written as NDJSON feeds, a file for each source, appended to by event logs, and read back: lines, bad ones, records."""
    rows = detailed(listings(spark, sf_dir))
    path = shared_path(spark, "feeds")
    o = F.col("order_id")
    text = lambda c: F.col(c).cast("string")
    record = F.to_json(F.struct(text("id").alias("id"), "make", F.col("title").alias("model"), text("year").alias("year"), text("km").alias("km"), text("price").alias("price"), F.when(o % 6 == 0, (F.col("price") - 500).cast("string")).alias("cash_price"), "country", "detail_url", F.when(o % 3 == 0, "private seller").otherwise("dealer").alias("seller_type"), F.when(o % 9 == 0, "price_change").alias("event")))
    line = F.when(o % 13 == 0, F.concat(F.lit("{"), F.col("id"))).otherwise(record)
    feeds.append_lines(rows.where("order_id % 8 = 0").select(line.alias("line"), F.concat(F.lit("cars-"), F.lower("country")).alias("source")), path)
    feeds.append_lines(rows.where("order_id % 8 <> 0").select(line.alias("line"), F.concat(F.lit("cars-"), F.lower("country"), F.lit("-events")).alias("source")), path)
    raw = feeds.read_folders(spark, path)
    typed = ndjson.records(raw).withColumn("source", F.concat(F.lit("cars-"), F.lower("country")))
    found = typed.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("event") == "price_change").alias("price_changes"), F.sum("price").cast("bigint").alias("prices"), F.count_if(F.col("seller_type") == "particular").alias("private"))
    return feeds.line_counts(raw).join(found, "source").select("source", "lines", "bad", "records", "price_changes", "prices", "private")
