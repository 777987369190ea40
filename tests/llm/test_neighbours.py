import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlake.llm import neighbours
from motorlake.llm.common import table
from motorlake.llm.queries import op12_nearest_vectors

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def is_query():
    return F.col("vec_id") % 50 == 0


@pytest.fixture
def make(spark):
    return lambda rows, parts=3: spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(parts)


def brute(rows, k=5):
    """Every query against every other row."""
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(kept):
        if i % 50 == 0:
            scores = sorted((-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j) for m, (j, w) in enumerate(kept) if m != n and len(w) == len(v))
            out.append((i, [(j, -s) for s, j in scores[:k]]))
    return sorted(out, key=repr)


def found(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(x) for i, x in by.items()}


def recall(rows, df):
    got, hits, total = found(df), 0, 0
    for i, want in brute(rows):
        assert [r for r, _, _ in got[i]] == list(range(1, len(want) + 1))
        assert all(a[2] >= b[2] for a, b in zip(got[i], got[i][1:], strict=False))
        exact = dict(want)
        for _, j, s in got[i]:
            if j in exact:
                assert s == pytest.approx(exact[j], abs=1e-12)
        hits += len({j for j, _ in want} & {j for _, j, _ in got[i]})
        total += len(want)
    return hits / total


def test_corpus(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, small, "embeddings").collect()]
    assert recall(rows, op12_nearest_vectors(spark, small)) >= 0.98


@pytest.mark.parametrize("spread", [0.05, 10.0])
def test_many_shards_and_blocks(make, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    chance = np.random.default_rng(4)
    centres = chance.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + spread * chance.standard_normal(24)).tolist()) for i in range(3000)]
    assert recall(rows, neighbours.nearest(make(rows), is_query(), shard=400)) >= 0.95


def test_a_third_of_rows_nearly_alike(make):
    chance = np.random.default_rng(5)
    hot = chance.standard_normal(16)
    rows = [(i, (hot + (1e-3 if i % 3 == 0 else 1.0) * chance.standard_normal(16)).tolist()) for i in range(2000)]
    assert recall(rows, neighbours.nearest(make(rows), is_query(), shard=256)) >= 0.95


def test_ties_repeats_and_unsound_rows(make):
    one = [1.0, 2.0, 0.0]
    rows = [(50, one), (3, one), (2, [2.0, 4.0, 0.0]), (9, one), (7, one), (8, one), (1, one), (100, [0.0, 0.0, 1.0])]
    unsound = [(None, one), (150, None), (200, []), (250, [0.0, 0.0, 0.0]), (300, [None, 1.0, 1.0]), (350, [float("nan"), 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0])]
    got = found(neighbours.nearest(make(rows + unsound), is_query()))
    assert [j for _, j, _ in got[50]] == [1, 2, 3, 7, 8]
    assert set(got) == {50, 100}
    # a query repeated is a candidate of the other row, and both have results
    twice = neighbours.nearest(make([(50, one), (50, one), (4, [1.0, 0.0, 0.0])]), is_query()).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in twice) == [(1, 50), (1, 50), (2, 4), (2, 4)]


def test_lengths_few_rows_and_extremes(make):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [-1.0, -1.0]), (50, [1.0, 2.0, 3.0]), (100, [5.0])]
    got = found(neighbours.nearest(make(rows), is_query()))
    assert [j for _, j, _ in got[0]] == [1, 2]
    assert got[0][1][2] == pytest.approx(-1.0)
    assert set(got) == {0}


def test_empty_table_and_clashing_columns(make):
    assert neighbours.nearest(make([]), is_query()).count() == 0
    clash = make([(0, [1.0, 0.0]), (1, [1.0, 1.0])]).withColumns({c: F.lit("x") for c in ("row", "vec", "dim", "shard", "score", "rank")})
    assert found(neighbours.nearest(clash, is_query()))[0][0][1] == 1
