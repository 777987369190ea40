"""Nearest names through deletion variants against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from motorlake.operators import aliases


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("reach", [1, 2])
def test_equals_all_pairs(spark, reach):
    rng = random.Random(reach)
    names = {(f"m{rng.randrange(4)}", "".join(rng.choices("abc", k=rng.randrange(0, 7)))) for _ in range(150)} | {("m9", "alone"), ("m8", "é"), ("m8", "e")}
    df = spark.createDataFrame(sorted(names), "block string, name string")
    got = {(r["block"], r["name"]): (r["distance"], r["nearest"]) for r in aliases.nearest_names(df, df, reach).collect()}
    want = {}
    for block, name in names:
        others = [(edits(name, n), n) for b, n in names if b == block and n != name]
        if others:
            want[block, name] = min(others)
    assert got == want


def test_variants(spark):
    row = spark.range(1).select(aliases.variants(F.lit("abc"), 2).alias("v"), aliases.variants(F.lit(""), 2).alias("e")).first()
    assert (set(row["v"]), row["e"]) == ({"abc", "ab", "ac", "bc", "a", "b", "c"}, [""])


def test_gap(spark):
    make = lambda rows: spark.createDataFrame(rows, "block string, name string")
    listed = make([("vw", "golff"), ("vw", "golff"), ("vw", "golf"), ("kia", "ceed"), ("vw", None)])
    rows = aliases.alias_gap(listed, make([("vw", "golf"), ("vw", "polo")])).collect()
    assert sorted(((r["block"], r["name"], r["listings"], r["nearest"], r["distance"]) for r in rows), key=repr) == [("kia", "ceed", 1, None, None), ("vw", "golff", 2, "golf", 1), ("vw", None, 1, None, None)]
