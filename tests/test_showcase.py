"""Estimates that only what changed is computed for, and cards whose fields have an origin."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from motorlake.operators import alerts, estimates, market, showcase
from motorlake.operators.search import Filters
from motorlake.plans.estimate_queries import DAYS, NOW, TAX_DAY, full
from motorlake.session import stored


@pytest.fixture(scope="module")
def feed(spark, small):
    rows = full(spark, small).withColumn("family", F.split_part("model_id", F.lit("|"), F.lit(1))).withColumn("updated_at", F.expr("TIMESTAMP '1990-01-01'"))
    return stored(rows, "test-feed")


def run(rows, only=None):
    return estimates.estimate(rows, F.expr(NOW), F.expr(TAX_DAY), DAYS, only=only)


def content(df):
    return Counter(tuple(r) for r in df.select(*estimates.ESTIMATE, "inputs").collect())


def test_a_second_feed_recomputes_what_it_touches(spark, feed):
    """The estimates after a second feed of home observations are those of a full run, though fewer listings were asked for."""
    late = (F.col("country") == "PT") & (F.col("model_id") == "ECONOMY|1") & (F.col("order_id") % 2 == 0)
    first = stored(feed.where(~late), "test-first")
    old = stored(run(first), "test-old")
    fresh = feed.where(late).select("model_id", "year", market.km_band(F.col("km")).alias("km_band"))
    # unmatched listings without an estimate are due at every run; here only listings with one, or touched ones, can change
    due = stored(estimates.due(feed.where(F.col("country") != "PT"), old, fresh), "test-due")
    after = estimates.merged(old, run(feed, due), due)
    assert content(after) == content(run(feed))
    assert 0 < due.count() < feed.where("country <> 'PT'").count()
    assert fresh.count() > 0


def test_norm_and_age_follow_the_registration(spark, feed):
    """A car listed as of 2019 but registered before has the older norm's emissions, and its exact age."""
    known = "struct(1500 AS cc, 150 AS co2_wltp, 110 AS co2_nedc, 120 AS power, '' AS derivative, 2010 AS gen_start, CAST(NULL AS INT) AS gen_end)"
    rows = spark.range(3).selectExpr(
        "id", "2019 AS year", "CASE id WHEN 0 THEN DATE '2018-11-30' WHEN 1 THEN DATE '2019-01-02' END AS first_registration", "'exato' AS match_confidence", "'v1' AS version_id", f"{known} AS version", f"CASE WHEN id > 9 THEN {known} END AS facts",
        "false AS gen_ambiguous", "CAST(NULL AS INT) AS cc", "CAST(NULL AS INT) AS co2", "CAST(NULL AS INT) AS power_hp",
    )
    got = {r["id"]: (r["co2_used"], r["registered_on"].isoformat(), r["registered_assumed"], r["from_catalog"]) for r in estimates.effective_specs(rows).collect()}
    filled = ["cc", "co2", "power"]
    assert got == {0: (110, "2018-11-30", False, filled), 1: (150, "2019-01-02", False, filled), 2: (150, "2019-07-01", True, filled)}


LISTING = "id string, model_id string, country string, match_confidence string, version_id string, facts struct<cc:int,co2_wltp:int,co2_nedc:int,power:int,mid:string>, detail_url string, vin string, deleted_at timestamp, make_raw string, model_raw string, variant string, fuel string, gearbox string, cc int, co2 int, power_hp int, year int, km int, price int, source_id string, source_site string, image_url string, last_seen_at timestamp"
ESTIMATE = "id string, transport int, isv int, iuc int, legalization int, total_pt bigint, pt_estimated_price int, pt_sample_size int, pt_confidence string, savings bigint, savings_pct double, verdict string"


@pytest.fixture(scope="module")
def cards(spark):
    def listing(i, **more):
        base = dict(id=i, model_id="m", country="DE", match_confidence=None, version_id=None, facts=None, detail_url=f"https://x/{i}", vin=None, deleted_at=None, make_raw=None, model_raw=None, variant=None, fuel=None, gearbox=None, cc=None, co2=None, power_hp=None, year=2020, km=50000, price=20000, source_id="s", source_site="site", image_url=None, last_seen_at=None)
        return tuple((base | more).values())

    facts = (1300, 120, 100, 90, "c2")
    rows = [
        listing("own", match_confidence="exato", version_id="v1", cc=1111, co2=99, power_hp=77, fuel="diesel", gearbox="DSG", image_url="https://i/250x188.webp"), listing("version", match_confidence="exato", version_id="v1", year=2018, vin="WVWZZZ1KZAW000001"),
        listing("facts", match_confidence="designacao", facts=facts, source_id="?"), listing("model", make_raw="VW", model_raw="Golf", variant="GTI", km=60000), listing("nothing", km=70000), listing("gone", match_confidence="exato", version_id="v1", deleted_at=None, price=1),
        listing("other tier", match_confidence="designacao", version_id="v1"),
    ]
    money = [(r[0], 950, 1, 1, 355, 22000, 25000, 9, "alargada" if r[0] == "gone" else "normal", 3000 + n, 12.0 + n, "compensa") for n, r in enumerate(rows)]
    models = spark.createDataFrame([("m", "volkswagen", "golf", "gasolina", 1400, 130, 110)], "model_id string, make string, model string, fuel string, cc int, co2 int, power_hp int")
    versions = spark.createDataFrame([("v1", 1200, 140, 115, 85, "G16 8 Series", None, "c1")], "version_id string, cc int, co2_wltp int, co2_nedc int, power int, name string, image_url string, mid string")
    catalog = spark.createDataFrame([("c1", "BMW", "8 Series (G16)", ["https://c1"]), ("c2", "VW", "Golf (Mk7)", None)], "mid string, make string, model string, image_urls array<string>")
    sources = spark.createDataFrame([("s", "Site")], "source_id string, source_name string")
    joined = showcase.joined(spark.createDataFrame(rows, LISTING), spark.createDataFrame(money, ESTIMATE), models, versions, catalog, sources)
    return stored(showcase.mapped(joined), "test-cards")


def test_fields_know_their_origin(cards):
    got = {r["id"]: r for r in cards.collect()}
    pair = lambda i, c: (got[i][c]["value"], got[i][c]["origin"])
    assert [pair(i, "displacement") for i in ("own", "version", "facts", "model", "other tier")] == [(1111, "listing"), (1200, "version"), (1300, "facts"), (1400, "model"), (1400, "model")]
    assert [pair(i, "co2") for i in ("own", "version", "facts", "model")] == [(99, "listing"), (115, "version"), (120, "facts"), (130, "model")]
    assert [pair(i, "power") for i in ("own", "version", "facts", "model")] == [(77, "listing"), (85, "version"), (90, "facts"), (110, "model")]
    assert [pair(i, "fuel") for i in ("own", "model")] == [("diesel", "listing"), ("gasolina", "model")]
    assert [pair(i, "title") for i in ("version", "facts", "model", "nothing")] == [("BMW 8 Series", "version"), ("VW Golf 90 cv", "facts"), ("VW GTI", "listing"), ("Anúncio", "none")]
    assert [got[i]["gearbox"] for i in ("own", "version")] == ["auto", None]
    assert [got[i]["source"] for i in ("own", "facts")] == ["Site", "site"]
    assert (got["own"]["photo"], got["own"]["catalog_image"], got["facts"]["catalog_image"]) == ("https://i/640x480.webp", "https://c1", None)
    assert [got[i]["km_trust"] for i in ("own", "version")] == ["por_verificar", "disponivel"]


def test_pages_of_a_stored_showcase(spark, cards, tmp_path):
    shown = showcase.representatives(cards)
    assert {r["id"] for r in shown.collect()} == {"own", "version"}
    rows = spark.range(500).withColumnRenamed("id", "n").join(cards.where("id = 'own'")).withColumns({"id": F.format_string("x%03d", "n"), "savings_pct": (F.col("n") % 97).cast("double")}).drop("n")
    path = str(tmp_path / "showcase")
    showcase.store(rows, path, slot_rows=50)
    opened = showcase.open_showcase(spark, path)
    assert sum(n for _, n in opened.slots) == 500 and len(opened.slots) == 10
    for page in (1, 2, 5):
        filters = Filters.parse(f"page={page}")
        want = [r["id"] for r in rows.orderBy(*filters.order()).offset(24 * (page - 1)).limit(24).collect()]
        assert [r["id"] for r in showcase.page(opened, filters).collect()] == want
    assert opened.first(24).select("slot").distinct().count() == 1
    assert showcase.total(opened, Filters.parse("q=bmw SERIES&fuel=diesel&country=DE")).first()[0] == 500
    assert showcase.total(opened, Filters.parse("q=golf")).first()[0] == 0
    assert showcase.page(showcase.Showcase(opened.rows, []), Filters()).count() == 0


def test_alerts(spark):
    made = "alert_id int, stand_id int, active boolean, make_key string, model_key string, make string, model string, countries array<string>, max_price int"
    rows = [
        (1, 1, True, "volkswagen", "golf", None, None, [], None), (2, 1, True, None, None, "VW", "Golf VII", ["DE"], 22000), (3, 2, True, None, None, None, "Golf", [], None), (4, 2, False, "volkswagen", "golf", None, None, [], None),
        (5, 2, True, "volkswagen", "golf", None, None, ["FR", "FR"], None), (6, 3, True, "volkswagen", "", "BMW", "320d", None, None),
    ]
    watched = alerts.watched(spark.createDataFrame(rows, made))
    keys = {r["alert_id"]: (r["make_key"], r["model_key"]) for r in watched.collect()}
    assert keys == {1: ("volkswagen", "golf"), 2: ("volkswagen", "golf"), 3: (None, None), 4: ("volkswagen", "golf"), 5: ("volkswagen", "golf"), 6: ("bmw", "serie-3")}
    offers = spark.createDataFrame([("a", "volkswagen", "golf", "DE", 21000, 1, 5), ("b", "volkswagen", "golf", "FR", 30000, 1, 6), ("c", "bmw", "serie-3", None, 1, 1, 7)], "id string, make_key string, model_key string, country string, total_pt int, savings int, seen_at int")
    found = alerts.matches(watched, offers)
    assert sorted((r["alert_id"], r["id"]) for r in found.collect()) == [(1, "a"), (1, "b"), (2, "a"), (5, "b"), (6, "c")]
    earlier = spark.createDataFrame([(1, "a"), (2, "zzz")], "alert_id int, id string")
    assert sorted((r["alert_id"], r["id"]) for r in alerts.new_matches(found, earlier).collect()) == [(1, "b"), (2, "a"), (5, "b"), (6, "c")]
    assert sorted((r["stand_id"], r["id"], r["place"]) for r in alerts.notifications(found, 1).collect()) == [(1, "b", 1), (2, "b", 1), (3, "c", 1)]


def test_sources_there_several_times(spark, small, tmp_path):
    """The stored showcase has the representatives of all cards, without a row of each card for every copy of its source on the way."""
    from motorlake.plans import showcase_queries

    for path in Path(small).glob("*.parquet"):
        (tmp_path / path.name).symlink_to(path)
    (tmp_path / "supplier.parquet").unlink()
    once = spark.read.parquet(f"{small}/supplier.parquet")
    once.unionByName(once.withColumn("s_suppkey", F.col("s_suppkey") + 10**6)).write.parquet(f"{tmp_path}/supplier.parquet")
    cards, shown = showcase_queries.cards(spark, str(tmp_path)), showcase_queries.shown(spark, str(tmp_path))
    assert cards.count() > cards.select("id").distinct().count()
    chosen = showcase.representatives(cards).select("id", "title.value", "source", "savings")
    assert sorted(map(tuple, shown.select("id", "title.value", "source", "savings").collect()), key=str) == sorted(map(tuple, chosen.collect()), key=str)
    told = showcase_queries.kept(spark, str(tmp_path), "shown", lambda: shown)
    assert showcase_queries.opened(spark, str(tmp_path)).rows.count() == told.count() == shown.select("id").distinct().count() > 0


def test_counts_of_matches_without_their_pairs(spark):
    index = "alert_id int, stand_id int, active boolean, make_key string, model_key string, countries array<string>, max_price int"
    watched = spark.createDataFrame([(i, i % 3, i % 7 != 0, None if i % 11 == 0 else "vw", "golf" if i % 2 else "polo", [None, [], ["DE"], ["FR", "FR", "DE"], ["ES", "*"]][i % 5], None if i % 4 == 0 else 90 + i) for i in range(120)], index)
    offers = spark.createDataFrame([(str(i), "vw", "golf" if i % 3 else "polo", ["DE", "FR", None][i % 3 - i % 2], None if i % 13 == 0 else 80 + i * 7 % 120, i, None if i % 5 == 0 else i * 31 % 97) for i in range(90)], "id string, make_key string, model_key string, country string, total_pt int, savings int, seen_at int")
    pairs = alerts.matches(watched, offers).groupBy("alert_id").agg(F.count("id").alias("n"), F.max("seen_at").alias("last_match"))
    counted = alerts.match_counts(watched, offers)
    assert sorted(map(tuple, counted.select("alert_id", "n", "last_match").collect())) == sorted(map(tuple, pairs.collect())) != []
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_what_derives_from_a_listing_is_not_stored_or_shuffled(spark, small):
    from motorlake.plans import estimate_queries, showcase_queries

    assert not {"detail_url", "facts", "version", "region"} & set(estimate_queries.stored_listings(spark, small).columns)
    plan = showcase_queries.shown(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (id#") == 1 and "LeftSemi" not in plan


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_owners_meet_matches_in_the_tasks_of_the_alerts(spark, small, monkeypatch):
    """However short the table of alerts and however few the stands, matches and their owners come from many tasks."""
    from motorlake.plans import showcase_queries

    whole = Counter(map(tuple, showcase_queries.alert_owners(spark, small).collect()))
    monkeypatch.setattr(alerts, "PART_ALERTS", 10, raising=False)
    owned = showcase_queries.alert_owners(spark, small)
    assert "hashpartitioning(stand_id#" not in executed(owned)
    assert owned.rdd.getNumPartitions() == -(-spark.read.parquet(f"{small}/customer.parquet").count() // 10) > 4
    assert Counter(map(tuple, owned.collect())) == whole


def test_raw_names_of_alerts_are_resolved_once_for_each_pair(spark):
    made = "alert_id int, make_key string, model_key string, make string, model string"
    rows = [(i, "vw" if i % 5 == 0 else None, "golf" if i % 10 == 0 else None, ["VW", "BMW", None][i % 3], ["Golf VII", "320d", None, ""][i % 4]) for i in range(600)]
    watched = alerts.watched(spark.createDataFrame(rows, made))
    got = {r["alert_id"]: (r["make_key"], r["model_key"]) for r in watched.collect()}
    assert len(got) == watched.count() == 600 and watched.columns == ["alert_id", "make_key", "model_key", "make", "model"]
    assert [got[i] for i in (0, 3, 13, 8, 12)] == [("vw", "golf"), (None, None), ("bmw", "serie-3"), (None, None), ("volkswagen", "golf")]
    plan = watched._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_make#" in plan and "translate" not in plan[: plan.index("Join LeftOuter")]


def test_new_matches_are_not_shuffled(spark, small, monkeypatch):
    from motorlake.plans import showcase_queries

    monkeypatch.setattr(alerts, "PART_ALERTS", 10, raising=False)
    fresh = showcase_queries.alert_matches(spark, small)
    assert "Exchange hashpartitioning(alert_id#" in executed(fresh)
    assert not [x for x in executed(fresh).splitlines() if "hashpartitioning(alert_id#" in x and ", id#" in x]
    want = Counter(map(tuple, fresh.collect()))
    told = [r for r in showcase_queries._matches(spark, small).collect() if (r["alert_id"] + r["total_pt"]) % 3 != 0]
    assert want == Counter((r["alert_id"], r["id"]) for r in told)
    monkeypatch.setattr(showcase_queries, "SENT_OFFERS", 0, raising=False)
    monkeypatch.setattr(alerts, "PART_ALERTS", 7, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sorted_ones = showcase_queries.alert_matches(spark, small)
        assert Counter(map(tuple, sorted_ones.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_new_matches_are_those_that_an_anti_join_leaves(spark):
    found = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, "b", 5), (2, "a", 6), (2, None, 7), (None, "a", 8), (3, "c", None)], "alert_id int, id string, savings int")
    earlier = spark.createDataFrame([("b", 1), ("b", 1), ("zzz", 2), (None, 2), ("a", None), ("c", 4)], "id string, alert_id int")
    want = Counter(map(tuple, found.join(earlier, ["alert_id", "id"], "left_anti").select(*found.columns).collect()))
    for found, earlier in ((found, earlier), (alerts.dealt(found, 9), alerts.dealt(earlier, 9))):
        fresh = alerts.new_matches(found, earlier)
        assert fresh.columns == found.columns and Counter(map(tuple, fresh.collect())) == want
