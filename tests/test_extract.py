"""Edge cases of the extractors over page state and specification pages, and of the catalog's rules."""

import pytest
from pyspark.sql import functions as F

from motorlake.operators import families, resolver, upkeep
from motorlake.sources import spec_pages, states


def pages(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "id int, html string")


def payload(text):
    return f'<script id="__NUXT_DATA__" type="application/json">{text}</script>'


def test_payloads_without_rows(spark):
    broken = [None, "", "<html></html>", payload("no json"), payload("[]"), payload('[{"a":1}]'), payload('[{"a":-1}]'), payload('[{"a":1},"text"]'), payload('[{"a":1},[]]')]
    assert states.pointer_rows(pages(spark, *broken), "id", ["a"], {"name": "string"}).count() == 0


def test_payload_with_shared_and_missing_nodes(spark):
    html = payload('[["Reactive",1],{"a":2},[3,3,-1,99,4],{"name":5,"n":6},{"n":-3},"x [\\"y\\"]",7]')
    found = states.pointer_rows(pages(spark, html), "id", ["a"], {"name": "string", "n": "int"}).orderBy("place").collect()
    assert [(r["place"], r["name"], r["n"]) for r in found] == [(0, 'x ["y"]', 7), (1, 'x ["y"]', 7), (2, None, None), (3, None, None), (4, None, None)]


def test_blobs_without_cards_and_a_long_one(spark):
    long = '<script>self.__next_f.push([1,"' + 'a\\"' * 200_000 + '\\"vdpPath\\":\\"/de/d/7-x\\""])</script>'
    found = states.component_cards(pages(spark, None, "", "<html></html>", '<script>self.__next_f.push([1,"no card"])</script>', long), "id").collect()
    assert [(r["id"], r["card"], r["auRating"]) for r in found] == [(4, "7", None)]


def test_spec_pages_without_rows(spark):
    empty = pages(spark, None, "", "<div class='versions_div' id='petrol_engines'></div>")
    assert spec_pages.version_rows(empty, "id").count() == 0
    assert [r["body"] for r in spec_pages.spec_sheet(empty, "id").collect()] == [None] * 3


@pytest.mark.parametrize(("text", "number"), [("1,5 l", 1.5), ("-3", -3.0), ("none", None), (None, None), ("1498 cm3 or 91.4", 1498.0)])
def test_first_number(spark, text, number):
    assert spark.range(1).select(spec_pages.first_number(F.lit(text).cast("string"))).first()[0] == number


def test_unknown_slugs_fail_where_asked(spark):
    known = spark.createDataFrame([("Seat", "Leon")], "make string, slug string")
    unknown = spark.createDataFrame([("Seat", "--")], "make string, slug string")
    strict = lambda df: families.with_families(df, strict=True).select("family")
    assert strict(known).first()[0] == "leon"
    with pytest.raises(Exception, match="no family for Seat/--"):
        strict(unknown).collect()


@pytest.mark.parametrize(("guessed", "model", "tokens", "wrong"), [(True, "Grand i10", ["grand", "santa", "fe"], True), (True, "Grand i10", ["i10", "grand", "x"], False), (False, "Grand i10", [], False), (None, "Grand", [], False), (True, "", None, False), (True, "Grand", None, True)])
def test_guessed_families(spark, guessed, model, tokens, wrong):
    row = spark.createDataFrame([(guessed, model, tokens)], "g boolean, m string, t array<string>")
    assert row.select(resolver.guessed_wrong(F.col("g"), F.col("m"), F.col("t"))).first()[0] is wrong


def test_snapshots_don_t_depend_on_order(spark):
    rows = [("b", 1, None), ("a", 2, "x"), ("a", 1, "x")]
    lines = lambda r: [x["line"] for x in upkeep.snapshot(spark.createDataFrame(r, "k string, n int, t string"), ["k"]).collect()]
    assert lines(rows) == lines(rows[::-1]) == ['{"k":"a","n":1,"t":"x"}', '{"k":"a","n":2,"t":"x"}', '{"k":"b","n":1,"t":null}']


def test_pages_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    from motorlake.plans import extract_queries

    parts = spark.range(400_000).selectExpr("id AS p_partkey", "sha2(string(id), 256) AS p_name", "'Brand#1' AS p_brand", "sha2(string(-id), 256) AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for pages in (extract_queries.spec_site, extract_queries.pointer_pages, extract_queries.component_pages):
        assert pages(spark, str(tmp_path)).select("html").rdd.getNumPartitions() > 1


def test_logs_are_compressed_and_files_bounded(spark, tmp_path, monkeypatch):
    from motorlake.operators import feeds

    monkeypatch.setattr(feeds, "FILE_LINES", 40, raising=False)
    lines = spark.range(0, 100, 1, 1).selectExpr("""concat('{"id":"', id, '"}') AS line""", "'cars-de' AS source")
    for source in ("cars-de", "cars-de-events"):
        feeds.append_lines(lines.withColumn("source", F.lit(source)), str(tmp_path))
    files = sorted(tmp_path.glob("source=*/*.gz"))
    assert len(files) == 6
    counted = feeds.line_counts(feeds.read_folders(spark, str(tmp_path))).first()
    assert (counted["source"], counted["lines"], counted["bad"]) == ("cars-de", 200, 0)
