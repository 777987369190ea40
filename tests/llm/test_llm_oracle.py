"""Queries with an oracle give its rows, on the driver's tables and on awkward ones."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from motorlake.llm.oracle import ORACLE_SQL
from motorlake.llm.queries import QUERIES

LINE = "This is a line of more than forty characters, shared."
AWKWARD = [
    (1, None), (2, ""), (3, "\n\n"), (4, f"\t{LINE.upper()} \nown"), (5, f"{LINE}\n{LINE}"), (6, LINE), (7, f"a\n {LINE}\x0b"), (8, LINE + "\n"),
    (9, "one two three four five six one two three four five seven eight nine"), (10, "# $ % & | < > * a b c d"), (11, "der die und Straße ÄÖÜ! x y z w v u t"),
    (12, "same line\nsame line\nthe of and to in that is was for with"), (13, "the of and to in that is was for with by"),
]


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(r[i] for i in order) for r in found)


def compare(spark, name, folder):
    ours = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    theirs = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_oracle(spark, name, folder):
    compare(spark, name, folder)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_awkward_texts(spark, name, tmp_path):
    spark.createDataFrame(AWKWARD, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, name, str(tmp_path))
