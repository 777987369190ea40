"""Queries that take rows out of fetched pages and event payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.plans.registry import query
from motorlake.sources import pages
from motorlake.sources.tables import table


@query("SELECT page_id, CAST(place - 1 AS INTEGER) AS place, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages))")
def html_links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(table(spark, sf_dir, "pages"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def html_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') AS lang, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def page_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *pages.url_parts(F.col("url")))


@query("SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def page_title_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit("<p[ >]")).cast("bigint").alias("paragraphs"), F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))
