"""Extractors over a column of fetched HTML: embedded JSON, structured data, links, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def script_json(html: Column, marker: str) -> Column:
    """The text of the first script whose tag holds ``marker`` (an id or a type), or null."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<script[^>]*{marker}[^>]*>(.*?)</script>", 1), F.lit(""))


def next_data(html: Column) -> Column:
    return script_json(html, '__NEXT_DATA__')


def state_json(html: Column) -> Column:
    return script_json(html, "ng-state")


def linked_data(html: Column) -> Column:
    """All application/ld+json blocks as an array of JSON texts, control characters removed."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[\x00-\x1f]+", " "))


def pick(json: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(json, path).try_cast(kind)


def strip_tags(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href) of every link in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def sitemap(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))


def gallery(html: Column, pattern: str = r"\.(?:jpe?g|png|webp)(?:\?|$)") -> Column:
    """Distinct https image addresses in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(r'<img[^>]*\ssrc="([^"]*)"'), F.lit(1)), lambda u: u.startswith("https://") & u.rlike(pattern)))


def labelled_rows(html: Column) -> Column:
    """A map of the label and value cells of two-column table rows; the first of a label wins, "-" is missing."""
    row = r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*<td[^>]*>(.*?)</td>\s*</tr>"
    keys = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(1)), strip_tags)
    values = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(2)), strip_tags)
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: (x["k"] != "") & ~x["v"].isin("-", ""))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(first)


def url_parts(url: Column) -> list[Column]:
    number = F.nullif(F.regexp_extract(url, "/([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return [F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("host"), F.nullif(F.regexp_extract(url, "^https?://[^/]+/([a-z]{2})/", 1), F.lit("")).alias("lang"), number.alias("number")]


def with_extras(rows: DataFrame, extras: DataFrame, key: str) -> DataFrame:
    """Structured rows with what the cards of the same page add; columns of the rows win, extras fill their nulls."""
    add = [c for c in extras.columns if c != key]
    renamed = extras.select(key, *[F.col(c).alias(f"_extra_{c}") for c in add])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(c, f"_extra_{c}").alias(c) if c in add else F.col(c) for c in rows.columns], *[F.col(f"_extra_{c}").alias(c) for c in add if c not in rows.columns])
