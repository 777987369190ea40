import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorlake.llm import align

FILES = align.public_files()


def table():
    """Byte of each visible character, from the rule that byte-level vocabularies follow."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def spans(words):
    out, at = [], 0
    for w in words:
        out.append((at, at + len(w)))
        at += len(w)
    return out


class Brute:
    def __init__(self, docs):
        entries, byte = Tokenizer.from_file(FILES.entries), table()
        entries.encode_special_tokens = True
        names = {i: w for w, i in entries.get_vocab().items()}
        model = sentencepiece.SentencePieceProcessor(model_file=FILES.pieces)
        self.rows, pairs = [], Counter()
        for i, text in docs:
            a = entries.encode(" " + text, add_special_tokens=False).ids if text else []
            b = model.encode(text) if text else []
            pieces = [model.id_to_piece(x) for x in b]
            left = [bytes(byte[c] for c in names[x]) for x in a]
            right = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            want = b" " + (text or "").encode()
            if not text or b"".join(left) != want or b"".join(right) != want:
                a, b, left, right = [], [], [], []
            a_spans, b_spans = spans(left), spans(right)
            linked = [(x, y) for x, s in zip(a, a_spans) for y, t in zip(b, b_spans) if s[0] < t[1] and t[0] < s[1]]
            ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
            groups, begin = [], 0
            for end in ends:
                groups.append(",".join(str(x) for x, s in zip(a, a_spans) if begin < s[1] <= end) + "|" + ",".join(str(x) for x, s in zip(b, b_spans) if begin < s[1] <= end))
                begin = end
            self.rows.append([i, len(a), len(b), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
            pairs.update(set(linked))
        self.pairs, best = pairs, Counter()
        for (a, _), n in pairs.items():
            best[a] = max(best[a], n)
        self.found = Counter((i, na, nb, g, len(linked), sum(pairs[p] == best[p[0]] for p in linked), sum(pairs[p] for p in linked), digest) for i, na, nb, g, linked, digest in self.rows)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "Hello world, it's <|endoftext|> <s> here"),
    (5, "Straße 日本語 😀 naïve"),
    (6, "line one\n\n  two\t\x0bthree 　 \xa0"),
    (7, "aaaa" * 50),
    (7, "aaaa" * 50),
    (None, "no id"),
    (None, None),
    (9, " " * 700 + "x" + "\n" * 300),
    (10, "▁ already a marker"),
    (11, "\x00 zero and <0x41>"),
    (12, "12345 67,89.0"),
]


def test_awkward_texts(spark, documents):
    brute = Brute(AWKWARD)
    assert got(align.align(documents(AWKWARD))) == brute.found


def test_corpus(spark, corpus):
    docs = [(r["doc_id"], (r["text"] or "")[:600]) for r in corpus.collect()]
    df = corpus.withColumn("text", F.substring("text", 1, 600)).repartition(5)
    brute = Brute(docs)
    assert got(align.align(df)) == brute.found
    counted = {(r["a"], r["b"]): r["n_docs"] for r in align.pair_counts(df).collect()}
    assert counted == dict(brute.pairs)


def test_salted_stripes_and_many_slices(spark, documents, monkeypatch):
    docs = [(i, f"the cat {i % 7} sat on the mat, number {i}") for i in range(60)]
    monkeypatch.setattr(align, "SLICE", 200)
    monkeypatch.setattr(align, "COMBINED", 50)
    monkeypatch.setattr(align, "CELLS", 3)
    monkeypatch.setattr(align, "salts", lambda df: 3)
    assert got(align.align(documents(docs).repartition(3))) == Brute(docs).found


def test_empty_table_and_clashing_columns(spark, documents):
    assert align.align(documents([])).count() == 0
    clash = documents([(1, "a b")]).withColumns({c: F.lit("x") for c in ("kind", "slice", "place", "stripe", "n_a", "key")})
    assert got(align.align(clash)) == Brute([(1, "a b")]).found


@pytest.mark.parametrize("text", ["中文字" * 300_000, "ab" * 1_000_000, " " * 1_000_000, "QUJD" * 500_000], ids=["han", "letters", "spaces", "base64"])
def test_long_text_without_a_break(text):
    own = align.tokenizers(FILES)
    found = align.aligned(own, [text])
    doc, a, b = align.links(found)
    assert len(a) == len(b) == len(found.a) + len(found.b) - len(align.group_texts(own, found)[0])
    assert np.all(doc == 0) or len(doc) == 0
