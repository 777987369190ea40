import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlake.llm import prefix_trie
from motorlake.llm.common import table
from motorlake.llm.queries import op13_prefix_trie

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture
def make(spark):
    return lambda rows, parts=3: spark.createDataFrame(rows, TURNS).repartition(parts)


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + v[h:]
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, held in members.items():
        ends = sorted(c for c in held if len(made[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_corpus(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, small)) == brute(rows)


def shared(n, seed):
    """Conversations that share beginnings of many lengths, copies of one among them."""
    chance = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        length = int(chance.integers(1, 14))
        words = ["a"] * length if c % 3 == 0 else [str(x) for x in chance.integers(0, 2, length)]
        rows += [(c, t, "user" if t % 2 == 0 else "bot", words[t] * (t + 1)) for t in range(length)]
    return rows


def grown(first, n):
    """Each conversation one turn longer than the one before: chains hang on chains as deep as the longest."""
    return [(first + 5 * c, t, "user", f"turn {t}") for c in range(n) for t in range(c + 1)]


def long(first, n):
    """One conversation holds most turns, another half of them."""
    return [(first, t, "user", f"é{t}") for t in range(n)] + [(first + 1, t, "user", f"é{t}") for t in range(n // 2)]


ODD = [(1001, None, None, None), (1001, 3, "user", ""), (1001, 3, "user", ""), (None, 1, "user", "lost"), (1007, 5, "bot", "b"), (1007, None, "user", "a"), (1012, 0, "user", "x"), (1013, 0, "user", "x"), (1014, 0, "", "x" * 200_000), (-7, 0, "user", "n"), (-5, 0, "user", "m"), (-5, 1, "user", "n")]


def test_shared_beginnings_long_chains_and_odd_rows(make, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART_IDS", 3)
    rows = shared(150, 1) + grown(2000, 20) + long(3000, 400) + ODD
    assert found(prefix_trie.prefix_trie(make(rows, 7))) == brute(rows)


def test_ties_of_turn_give_one_order(make):
    rows = [(c, 1, "user", t) for c in (0, 5) for t in ("p", "q", "r")]
    once, again = (found(prefix_trie.prefix_trie(make(x))) for x in (rows, rows[::-1]))
    assert once == again


def test_empty_table_and_clashing_columns(make):
    assert prefix_trie.prefix_trie(make([])).count() == 0
    rows = shared(12, 3)
    clash = make(rows).withColumns({c: F.lit("x") for c in ("conv", "place", "depth", "part", "first", "above", "h1")})
    assert found(prefix_trie.prefix_trie(clash)) == brute(rows)
