"""Extractors over the state that pages carry for their own scripts: index-pointer payloads and component blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlake.functions.semantics import let
from motorlake.sources.pages import pick, script_json

#: Tags of nodes that stand for the one node they point to.
WRAPPERS = "Object|Ref|Reactive|ShallowReactive|ShallowRef"
#: The fields of a card in a component blob, by kind.
CARD_TEXTS = ("sourceName", "equipmentVariant", "modelGeneration", "estimatedPrice")
CARD_NUMBERS = ("laytime", "youSaveDifference")
#: How far a card's fields reach behind its address, and its rating before it.
CARD_LENGTH, RATING_LENGTH = 1500, 90


def pointer_nodes(html: Column) -> Column:
    """The nodes of a page's index-pointer payload, each as its JSON text (strings without quotes); null without one.

    In such a payload, objects and arrays hold the numbers of other nodes, and node 0 is
    the root. The payload is parsed once; what is followed later are single small nodes.
    """
    return F.from_json(script_json(html, "__NUXT_DATA__"), "array<string>")


def node(nodes: Column, index: Column) -> Column:
    """The node of a number, through the wrappers around it (two at most); dates give their text, negative numbers null."""

    def unwrapped(text: Column) -> Column:
        inner = F.nullif(F.regexp_extract(text, rf'^\["(?:{WRAPPERS})",([0-9]+)\]$', 1), F.lit("")).try_cast("int")
        date = F.nullif(F.regexp_extract(text, r'^\["Date","([^"]*)"\]$', 1), F.lit(""))
        return F.coalesce(date, F.when(inner.isNotNull(), F.get(nodes, inner)).otherwise(text))

    return let(let(F.get(nodes, index), unwrapped), unwrapped)


def follow(nodes: Column, start: Column, *path: str) -> Column:
    """The node that a path of field names leads to from the node ``start``."""

    def step(at: Column, name: str) -> Column:
        return let(at, lambda n: node(nodes, pick(n, f"$.{name}", "int")))

    return reduce(step, path, start)


def members(nodes: Column, text: Column) -> Column:
    """The nodes that a list or set points to."""
    numbers = F.from_json(F.regexp_replace(text, r'^\["Set",?', "["), "array<int>")
    return F.transform(numbers, lambda n: node(nodes, n))


def pointer_rows(pages: DataFrame, key: str, path: list[str], fields: dict[str, str]) -> DataFrame:
    """(key, place, fields) of the objects in the list at ``path`` of each page's payload; fields are name to type."""
    found = pages.select(key, pointer_nodes(F.col("html")).alias("_nodes")).where("_nodes is not null")
    listed = members(F.col("_nodes"), follow(F.col("_nodes"), node(F.col("_nodes"), F.lit(0)), *path))
    rows = found.select(key, "_nodes", F.posexplode(listed).alias("place", "_item"))
    return rows.select(key, "place", *[follow(F.col("_nodes"), F.col("_item"), name).try_cast(kind).alias(name) for name, kind in fields.items()])


def component_blob(html: Column) -> Column:
    """The text that a page's server components push in pieces, each a string literal, joined."""
    literal = r'self\.__next_f\.push\(\[[0-9]+,\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\]\)'
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(literal), F.lit(1)), lambda s: F.get_json_object(F.concat(F.lit("["), s, F.lit("]")), "$[0]")), "")


def component_cards(pages: DataFrame, key: str) -> DataFrame:
    """(key, card, fields) of the cards in each page's component blob; the first of a card's repetitions wins.

    A card begins at its address, which holds its number, and ends where the next one
    begins; its rating stands right before the address.
    """
    pieces = F.split(component_blob(F.col("html")), r'(?="vdpPath":"/[a-z-]+/d/[0-9]+-)')
    cut = pages.select(key, pieces.alias("_pieces")).where(F.size("_pieces") > 1)
    tails = F.transform("_pieces", lambda p: F.right(p, F.lit(RATING_LENGTH)))
    rows = cut.select(key, tails.alias("_tails"), F.posexplode(F.transform("_pieces", lambda p: F.left(p, F.lit(CARD_LENGTH)))).alias("_place", "_card")).where("_place > 0")
    text = lambda pattern, source="_card", group=1: F.nullif(F.regexp_extract(source, pattern, group), F.lit(""))
    rows = rows.withColumn("_before", F.get("_tails", F.col("_place") - 1))
    leads = r'"outgoingPath":"/[a-z-]+/[^/"]+/([^/"]+)/[0-9]+/([0-9]+)"'
    image = F.get_json_object(F.concat(F.lit("["), text(r'"imageUrls":\[("[^"\\]*+(?:\\.[^"\\]*+)*+")'), F.lit("]")), "$[0]")
    cards = rows.select(
        key, "_place", text(r'^"vdpPath":"/[a-z-]+/d/([0-9]+)-').alias("card"),
        *[text(rf'"{name}":"([^"]*)"').alias(name) for name in CARD_TEXTS], *[text(rf'"{name}":(-?[0-9]+)').try_cast("bigint").alias(name) for name in CARD_NUMBERS],
        text(r'"isPrivateCar":(true|false)').try_cast("boolean").alias("isPrivateCar"), text(r'"auRating":([0-9]+)', "_before").try_cast("int").alias("auRating"),
        image.alias("image"), text(leads).alias("site"), text(leads, group=2).alias("site_id"),
    )
    first = Window.partitionBy(key, "card").orderBy("_place")
    return cards.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_place")
