"""Names that the catalog doesn't know, with the nearest one that it does.

Two names within k edits of each other are equal once at most k characters are deleted
from each, so names meet on equal deletion variants within a block, and only what meets
is compared. Names without any neighbour so near are compared with their whole block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edits within which neighbours are found through variants.
REACH = 2


def _deletions(name: Column) -> Column:
    """All strings with one character less."""
    places = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substr(name, i + 1)))


def variants(name: Column, reach: int = REACH) -> Column:
    """The name, and what is left of it without up to ``reach`` of its characters."""
    last = F.array(name)
    all_ = last
    for _ in range(reach):
        last = F.array_distinct(F.flatten(F.transform(last, _deletions)))
        all_ = F.concat(all_, last)
    return F.array_distinct(all_)


def nearest_names(asked: DataFrame, known: DataFrame, reach: int = REACH) -> DataFrame:
    """(block, name, nearest, distance): for each name of ``asked`` (block, name) the one of ``known`` (block, name) in its block with the fewest edits, of equals the first in order; names themselves don't count.

    A block bounds what names without near neighbours are compared with, so it should be
    as narrow as a make. Names of blocks that ``known`` doesn't have are left out.
    """
    asked, known = asked.select("block", "name").distinct(), known.select("block", F.col("name").alias("nearest")).distinct()
    met = asked.withColumn("variant", F.explode(variants(F.col("name"), reach))).join(known.withColumn("variant", F.explode(variants(F.col("nearest"), reach))), ["block", "variant"])
    distance = F.levenshtein("name", "nearest").alias("distance")
    near = met.where("name <> nearest").select("block", "name", "nearest").distinct().select("block", "name", "nearest", distance).where(F.col("distance") <= reach)
    alone = asked.join(near.select("block", "name").distinct(), ["block", "name"], "left_anti")
    far = alone.join(known, "block").where("name <> nearest").select("block", "name", "nearest", distance)
    best = Window.partitionBy("block", "name").orderBy("distance", "nearest")
    return near.unionByName(far).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def alias_gap(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(block, name, listings, nearest, distance): names of ``listed`` (block, name; a row for each listing) that ``known`` doesn't have, with their listings and nearest known name, null where the block is unknown."""
    missing = listed.groupBy("block", "name").agg(F.count("*").alias("listings")).join(known.select("block", "name").distinct(), ["block", "name"], "left_anti")
    return missing.join(nearest_names(missing, known), ["block", "name"], "left")
