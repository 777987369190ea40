import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from motorlake.llm.line_dedup import dropped_bitmaps, line_dedup

WHITE = " \t\n\x0b\f\r"
LONG = "A line that is certainly longer than forty characters"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key := lower(line.strip(WHITE))) >= 40:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(lower(x.strip(WHITE)), ())) < 5 or doc == max(holders[lower(x.strip(WHITE))])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def digest(out):
    return sorted(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect())


def test_corpus(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert digest(line_dedup(corpus)) == brute(rows)


def test_hot_lines_are_stitched(documents):
    rows = [(i, f"{LONG}\nown {i}\n  {LONG.upper()}\t") for i in range(300)]
    assert digest(line_dedup(documents(rows))) == brute(rows)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "É" * 40 + "\nx"), *[(i, "é" * 40) for i in range(5, 12)], *[(i, "y" * 39) for i in range(12, 20)], (30, "z\n" * 70000)]
    assert digest(line_dedup(documents(rows))) == brute(rows)


def test_repeated_rows_and_null_ids(documents):
    rows = [(i, LONG) for i in range(5)] + [(4, LONG), (0, LONG), (None, LONG)]
    got = {(r["doc_id"], r["n_dropped"]) for r in line_dedup(documents(rows)).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (None, 1)}


def test_other_columns_and_empty(documents):
    rows = documents([(i, LONG) for i in range(6)])
    out = line_dedup(rows.withColumn("n_lines", F.lit("x")).withColumn("word", F.lit(1)))
    assert set(out.columns) == {*rows.columns, "n_lines", "n_dropped", "word"} and out.count() == 6
    assert line_dedup(rows.limit(0)).count() == 0


def test_bitmaps_are_sparse(documents):
    bitmaps = dropped_bitmaps(documents([(i, "\n" * 130 + LONG) for i in range(5)])).collect()
    assert len(bitmaps) == 4
    assert all([(x["word"], x["bits"]) for x in r["dropped"]] == [(2, 1 << (130 - 128))] for r in bitmaps)
