import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorlake.llm import flat_tokens, orc_tokens
from motorlake.llm.vocabulary import WordEncoder, tokenizer_file

CASES = [None, "", " ", "Hello wörld, it's 2024!", "a" * 300, "x y\tz\n" * 50, "<|endoftext|> now", "é É", "日本語 テキスト", "don't\x0bstop", "Ümläut Ümläut"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_file())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = ["K\u0327e\u0301 E\u0301 I\u0307stanbul", "<|ENDOFTEXT|> <|endoftext|>x <|startoftext|>", "I'm he'LL o'clock 'tis", "\u0958 क़ Σίσυφος ΣΑΣ", "a.b, c!? (d) e-f _g_ 12 3a a3 ½ ²", "ÀÉÎ, ßtraße. ÑANDÚ!", "\u00a0x\u2003y\u3000z", "``` <tag> a<b a>b a|b", "zero\u200bwidth ﬁ Ǆ"]


def split(found):
    ids, offsets = found
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_word_cache_changes_nothing(library, corpus):
    enc = WordEncoder(tokenizer_file())
    texts = [*CASES, *HARD, *[r["text"] for r in corpus.collect()]]
    for part in (texts, texts[5:60], [], [None], texts[::-1]):
        found = enc.encode(pa.array(part, pa.string()))
        assert split(found) == [library(t) for t in part]
        assert split(enc.encode(pa.array(part, pa.string()), 1)) == [[*library(t), 1] for t in part]


def test_every_kind_of_word(library):
    chance = np.random.default_rng(5)
    signs = list("abzABZ àÉßÿ÷×.,'!<|>0²½`~_\t") + ["'s", "<|endoftext|>", "\u0301", "日", "ǅ"]
    texts = ["".join(chance.choice(signs, chance.integers(0, 12))) for _ in range(3000)]
    assert split(WordEncoder(tokenizer_file()).encode(pa.array(texts))) == [library(t) for t in texts]


def test_word_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr("motorlake.llm.vocabulary.KEPT_WORDS", 3)
    enc = WordEncoder(tokenizer_file())
    for text in ("one two three one two three", "four five four five", "six seven eight nine ten " * 2, "one nine " * 3, "one nine ten"):
        assert split(enc.encode(pa.array([text]))) == [library(text)]
        assert len(enc.kept.words) <= 3


def test_orc(spark, documents, library):
    rows = list(enumerate(CASES)) + [(3, "again"), (3, "again"), (3, None), (None, "no id"), (None, None)]
    found = orc_tokens.token_orc(documents(rows).withColumns({"start": F.lit("own"), "part": F.lit("own"), "n_tokens": F.lit("own")}), tokenizer_file()).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(
        ((i is not None, i or 0), len(library(t)) + 1, zlib.crc32(np.array([*library(t), 1], "<u4").tobytes())) for i, t in rows
    )
    start = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_start_is_the_place_in_the_files(spark, documents, tmp_path):
    rows = [(i % 4, "word " * (i * 7 % 5)) for i in range(40)] + [(9, "x " * 1_000_000)]
    path = str(tmp_path / "o")
    found = {(r["start"], r["n_tokens"]) for r in orc_tokens.token_orc(documents(rows), tokenizer_file(), path=path).collect()}
    want, start = set(), 0
    for r in sorted(orc_tokens.read_token_orc(spark, path).collect(), key=lambda r: (r["part"], r["place"])):
        want.add((start, len(r["ids"])))
        start += len(r["ids"])
    assert found == want and max(n for _, n in found) == 1_000_001


def test_orc_reads_by_id(spark, documents, library, tmp_path):
    orc_tokens.write_token_orc(documents([(i, f"text {i}") for i in range(50)]), str(tmp_path / "o"), tokenizer_file())
    found = orc_tokens.read_token_orc(spark, str(tmp_path / "o"), [7])
    assert "PushedFilters" in found._jdf.queryExecution().executedPlan().toString()
    assert [list(r["ids"]) for r in found.collect()] == [[*library("text 7"), 1]]


def test_orc_empty(documents):
    assert orc_tokens.token_orc(documents([(1, "x")]).limit(0), tokenizer_file()).count() == 0


def plain(text):
    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_flat_files(documents):
    rows = list(enumerate(CASES)) + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (-5, "x " * 600_000), (1 << 62, "large id")]
    found = flat_tokens.token_counts(documents(rows).repartition(5).withColumns({"start": F.lit("own"), "kind": F.lit("own"), "ordinal": F.lit("own")}), tokenizer_file()).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((key(r["doc_id"]), r["n_tokens"]) for r in found) == sorted((key(i), len(plain(t))) for i, t in rows)
    start = 0
    for n, r in enumerate(sorted(found, key=lambda r: r["ordinal"])):
        assert (r["ordinal"], r["start"]) == (n, start)
        start += r["n_tokens"] + 1


def test_flat_files_are_small(spark, documents, tmp_path):
    rows = [(i, f"text {i} <|endoftext|> " * 30) for i in range(60)]
    assert flat_tokens.id_width(tokenizer_file(), 49408) == 2 and flat_tokens.id_width(tokenizer_file(), 1 << 16) == 4
    flat_tokens.write_flat_tokens(documents(rows).repartition(3), str(tmp_path / "f"), tokenizer_file(), 49408, 2)
    ids, docs = ({p.name: p.read_bytes() for p in (tmp_path / "f" / f"kind={k}").glob("part-*")} for k in ("ids", "docs"))
    assert ids.keys() == docs.keys() and len(ids) == 3
    for name, data in docs.items():
        own = [int.from_bytes(data[at : at + 8], "little") for at in range(0, len(data), 11)]
        want = [x for i in own for x in (*plain(rows[i][1]), 49408)]
        assert np.frombuffer(ids[name], "<u2").tolist() == want


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_are_stitched(spark, tmp_path, block, width):
    end, chance = 7, np.random.default_rng(3)
    kind = f"<u{width}"
    files = [chance.integers(5, 9, n).astype(kind) for n in (40, 1, 23)] + [np.full(6, end, kind), np.array([1, 2, 3], kind)]
    folder = tmp_path / f"b{block}"
    folder.mkdir()
    for i, ids in enumerate(files):
        (folder / f"part-{i}").write_bytes(ids.tobytes())
    want, base = [], 0
    for ids in files:
        start = 0
        for at in [*np.flatnonzero(ids == end).tolist(), len(ids)]:
            if at < len(ids) or at > start:
                want.append((len(want), base + start, at - start))
            start = at + 1
        base += len(ids)
    assert sorted(tuple(r) for r in flat_tokens.count_tokens(spark, str(folder), end, width, block).collect()) == want


def test_flat_empty(documents):
    assert flat_tokens.token_counts(documents([(1, "x")]).limit(0), tokenizer_file()).count() == 0


def test_files_above_the_limit_of_binary_files(spark, tmp_path):
    size = (1 << 31) + 4096  # a sparse file: ids 0 but for three
    folder = tmp_path / "large files %20#1"
    folder.mkdir()
    with open(folder / "part-0", "wb") as f:
        for at in (5, 600_000_000 // 4, size // 4 - 2):
            f.seek(4 * at)
            f.write((7).to_bytes(4, "little"))
        f.truncate(size)
    block = 1 << 24
    blocks = flat_tokens.blocks_of(spark, str(folder), 4, block)
    assert blocks.count() == -(-size // (4 * block)) and blocks.rdd.getNumPartitions() > 1
    ends = [5, 150_000_000, size // 4 - 2, size // 4]
    want = [(n, a + 1, b - a - 1) for n, (a, b) in enumerate(zip([-1, *ends], ends))]
    assert sorted(tuple(r) for r in flat_tokens.count_tokens(spark, str(folder), 7, 4, block).collect()) == want
