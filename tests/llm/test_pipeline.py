"""The pipeline against a brute-force version in plain Python, stage by stage, and on awkward tables."""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from motorlake.llm.pieces import Codec, Pieces, model_file

WORDS = "stone river under night carry green follow window seven market paper silver winter garden morning letter bridge travel engine summer".split()
BENCH = "which of these four rivers carries the most water past the old stone bridge during winter"
SHARED = "this very line of boilerplate is found in many of the documents"


def prose(chance, n):
    return " ".join(chance.choice(WORDS) + str(chance.randrange(50)) for _ in range(n))


def rows():
    chance = random.Random(4)
    texts = [prose(chance, chance.randint(20, 80)) for _ in range(30)]
    texts += [texts[3], texts[3].upper(), texts[7]]
    texts += [f"{prose(chance, 40)}\n{SHARED}\n{prose(chance, 20)}" for _ in range(7)]
    texts += [f"{prose(chance, 15)} {BENCH} {prose(chance, 15)}", f"{prose(chance, 15)} {BENCH.replace('four', '4')} {prose(chance, 9)}", BENCH.upper()]
    texts += [None, "", "12345 --- 678", f"  {SHARED.upper()}  ", "x", "ein kurzer Satz über Häuser", "日本語の文章 🎉"]
    return [(i * 3 % 101, t, "de" if i % 5 == 0 else "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]


def without_unknown_language(docs):
    """All rows of this fixture have a lang, so none is filled in."""
    return [d for d in docs if d[1] is not None and any(c.isalpha() for c in d[1])]


def key(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)


def without_shared_lines(docs):
    held = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d[0])
    out = []
    for d in docs:
        left = "\n".join(x for x in (d[1] or "").split("\n") if len(held.get(key(x), ())) < 5 or d[0] == max(held[key(x)]))
        out.append((d[0], left, d[2], d[3], len(left)))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each_group(docs):
    prints, left, out = {d[0]: fingerprint(d[1]) for d in docs}, sorted(d[0] for d in docs), set()
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            a = todo.pop()
            near = {b for b in left if b not in group and (prints[a] ^ prints[b]).bit_count() <= 2}
            group |= near
            todo += near
        out.add(min(group))
        left = [b for b in left if b not in group]
    return [d for d in docs if d[0] in out]


def fewest_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def without_leaks(docs, bench):
    items = [re.findall(r"\w+", t.lower()) for t in bench]
    return [d for d in docs if all(fewest_edits(i, re.findall(r"\w+", d[1].lower())) > len(i) * 0.2 + 1e-9 for i in items if len(i) >= 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (3, "two words")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_does_what_brute_force_does(spark, folder, tmp_path):
    brute = {"language_id": without_unknown_language, "line_dedup": without_shared_lines, "simhash_near_dedup": one_of_each_group, "decontamination": lambda d: without_leaks(d, [BENCH, "two words"])}
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), rows()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs, before, want = spark.read.parquet(f"{tmp_path}/{name}"), len(want), brute[name](want)
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr), name
        assert len(want) < before or name == "line_dedup"
    name, stage = corpus_pipeline.STAGES[-1]
    codec, texts = Codec(Pieces(model_file())), {d[0]: d[1] for d in want}
    got = stage(spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["round_trip"] and codec.decode(*codec.encode([texts[r["doc_id"]]])) == [texts[r["doc_id"]]]
        assert r["n_ids"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
    final = sorted(json.dumps(r.asDict(), sort_keys=True) for r in corpus_pipeline.run(spark, folder).collect())
    assert final == sorted(json.dumps(r.asDict(), sort_keys=True) for r in got)


def test_stages_on_nulls_and_repeated_rows(spark, folder):
    awkward = [(None, None, None, None, None), (None, "some text of a row without id", None, None, None), (5, "the same text twice in two rows", "en", None, 31), (5, "the same text twice in two rows", "en", None, 31), (5, "the id again with other words in it", None, "s", None), (6, "", None, "s", 0)]
    docs = spark.createDataFrame(awkward, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        left[name] = stage(spark, docs, folder).collect()
    assert sorted(r["doc_id"] or 0 for r in left["language_id"]) == [0, 5, 5, 5]  # each row by its own text
    assert len(left["line_dedup"]) == 6
    assert sorted((r["doc_id"], r["text"]) for r in left["simhash_near_dedup"] if r["doc_id"] is not None) == [(5, awkward[4][1]), (5, awkward[2][1]), (6, "")]
    assert len(left["decontamination"]) == 6
    assert len(left["sentencepiece"]) == 6 and all(r["round_trip"] for r in left["sentencepiece"])


def test_stages_on_an_empty_table_with_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("lang_pred", "_lang_pred", "score", "n_lines", "n_dropped", "fingerprint", "component_id", "component", "item_id", "fp", "text_key", "row_key", "mark_id", "mark_key", "mark_dropped", "gone_id", "gone_key", "rows", "row", "ids")
    clash = docs.withColumns({c: F.concat(F.lit(f"own {c} "), F.col("doc_id")) for c in names}).withColumn("a map", F.create_map(F.lit("id"), F.col("doc_id")))
    twice = clash.unionByName(clash.where("doc_id < 20"))
    for table in (docs.limit(0), clash.limit(0), twice):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns
            rows = out.collect()
            assert rows or table.isEmpty()
            assert all(r[c] == f"own {c} {r['doc_id']}" for r in rows for c in names), name
            assert all(r["a map"] == {"id": r["doc_id"]} for r in rows if "a map" in r)
    assert corpus_pipeline.STAGES[-1][1](spark, clash, folder).count() == docs.count()


def test_clean_rows_with_null_and_repeated_ids_stay(spark, folder):
    chance = random.Random(8)
    a, b, c, d = (prose(chance, 60) for _ in range(4))
    made = [(None, a), (None, a), (None, b), (3, c), (5, c), (5, d), (None, d + " " + BENCH), (7, a + " " + BENCH), (7, b)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    left = [(r["doc_id"], r["text"]) for r in stages["decontamination"](spark, docs, folder).collect()]
    assert sorted(left, key=repr) == sorted([x for x in made if BENCH not in x[1]], key=repr)
    left = [(r["doc_id"], r["text"]) for r in stages["simhash_near_dedup"](spark, docs.limit(6), folder).collect()]
    assert sorted(left, key=repr) == sorted([(None, a), (None, b), (3, c), (5, d)], key=repr)
    made = spark.createDataFrame([(5, t, "en", None, 1) for t in (a, b, b, c)], docs.schema)
    left = [(r["doc_id"], r["text"]) for r in stages["simhash_near_dedup"](spark, made, folder).collect()]
    assert sorted(left) == sorted([(5, a), (5, b), (5, c)])  # one doc_id with texts of their own


def test_missing_languages_are_filled_in(spark, folder):
    made = [(i, "the cat and the dog and the bird", "en") for i in range(9)] + [(i, "der hund und die katze und das tier", "de") for i in range(9, 18)] + [(20, "die katze", None), (21, "the dog", None), (22, "the dog", "fr")]
    docs = spark.createDataFrame([(i, t, lang, None, len(t)) for i, t, lang in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, folder).collect()}
    assert len(left) == 21 and (left[20], left[21], left[22]) == ("de", "en", "fr")


def test_nothing_to_learn_from(spark, folder):
    docs = spark.createDataFrame([(1, "some words", None, None, 1), (2, "12", None, None, 1), (3, None, None, None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [tuple(r) for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, folder).collect()] == [(1, "some words", None, None, 1)]


def test_large_sets_of_dropped_rows_are_joined(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder).collect())
    monkeypatch.setattr("motorlake.llm.stages.BROADCAST_ROWS", 0)
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder).collect()) == want
