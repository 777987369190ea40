import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from motorlake.llm.pieces import Codec, DoubleArray, Pieces, encode_decode, model_file

CASES = ["", " ", "a", "  two  spaces ", "line\nbreak\r\ttab", "wörld 日本語 🎉", "x" * 500, "don't stop", "\n\n"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(model_file())


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram search over the same pieces; scores of -1e9 are beyond its single precision."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(model_file(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.score < -1e8:
            piece.score = -40000.0
    return SentencePieceProcessor(model_proto=model.SerializeToString())


def test_trie_finds_all_prefixes():
    keys = sorted({b"a", b"ab", b"abc", b"b", b"ba", b"\xff", b"\x00", b"a\x00"})
    trie = DoubleArray(keys)
    for word in (b"abcd", b"a\x00b", b"\xff", b"\x00\x00", b"c", b""):
        node, found = 0, []
        for byte in word:
            child = trie.base[node] + byte + 1
            if trie.check[child] != node:
                break
            node = child
            if trie.value[node] >= 0:
                found.append(keys[trie.value[node]])
        assert found == [word[:n] for n in range(1, len(word) + 1) if word[:n] in keys and all(any(k.startswith(word[:m]) for k in keys) for m in range(1, n + 1))]


def test_same_as_the_library(pieces, unigram, corpus):
    codec = Codec(pieces)
    for text in [r["text"] for r in corpus.limit(30).collect()]:
        for line in text.split("\n"):
            if "  " not in line:
                assert codec.encode([line])[0].tolist() == unigram.encode(line)


def brute(codec, pieces, word):
    """The best sum over all ways to cut a short word."""
    known = {}
    model = SentencePieceProcessor(model_file=model_file())
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            known[model.id_to_piece(i)] = model.get_score(i)
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            score = known.get(word[start:end], codec.unknown_score if end - start == 1 else None)
            if score is not None and best[start] is not None and (best[end] is None or best[start] + score > best[end]):
                best[end] = best[start] + score
    return best[-1]


def test_best_sum(pieces):
    codec = Codec(pieces)
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
    for word in ("▁tokenization", "▁erthnheanly", "▁▁▁", "abc"):
        assert sum(score[i] for i in codec.viterbi(word)) == brute(codec, pieces, word)


def test_round_trip(spark, documents, pieces, corpus):
    rows = documents([*enumerate(CASES), (50, None), (50, None)])
    for r in encode_decode(rows, pieces).collect():
        assert r["round_trip"] and r["decoded"] == (CASES[r["doc_id"]] if r["doc_id"] < 50 else "")
    assert all(r["round_trip"] for r in encode_decode(corpus, pieces).select("round_trip").collect())
    marked = encode_decode(documents([(1, "a▁b")]), pieces).first()
    assert not marked["round_trip"] and marked["decoded"] == "a b"
    assert encode_decode(rows.limit(0), pieces).count() == 0


def test_words_together_as_one_by_one(pieces, corpus):
    codec, chance = Codec(pieces), random.Random(3)
    signs = list("abcerstühß▁.,0-") + ["日", "🎉", "\n", "é", "\x00"]
    words = ["".join(chance.choice(signs) for _ in range(chance.randint(1, 14))) for _ in range(4000)] + ["▁" * 70, "ab" * 200, "é" * 33, "🎉" * 16, "🎉" * 17]
    words += [w for r in corpus.limit(50).collect() for w in f"▁{r['text'] or ''}".replace(" ", "▁").split("\n") if w]
    words = sorted(set(words))
    ids, sizes = codec._encode(pa.array(words))
    at = 0
    for word, n in zip(words, sizes.tolist()):
        assert tuple(ids[at : at + n].tolist()) == tuple(codec.viterbi(word).tolist()), word
        at += n
    assert at == len(ids)


def test_kept_words_change_nothing(pieces, monkeypatch):
    texts = ["one two three one two three", "", "four five four five one", "six seven\nsix seven", "one nine " * 3]
    want = [Codec(pieces).encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr("motorlake.llm.vocabulary.KEPT_WORDS", 3)
    codec = Codec(pieces)
    for _ in range(2):
        assert [codec.encode([t])[0].tolist() for t in texts] == want
        ids, offsets = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want and len(codec.kept.words) <= 3
        assert codec.decode(ids, offsets) == texts


def test_long_text_and_clashing_columns(documents, pieces):
    rows = documents([(1, "word " * 400_000), (2, "x" * 200_000)]).selectExpr("*", "'own' as ids", "'own' as decoded", "'own' as round_trip")
    assert [(r["doc_id"], r["round_trip"]) for r in encode_decode(rows, pieces).collect()] == [(1, True), (2, True)]


def test_long_text_without_white_space_needs_little_memory():
    code = """
import random, resource
from motorlake.llm.pieces import Codec, Pieces, model_file
codec = Codec(Pieces(model_file()))
codec.encode(["warm up " * 1000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "".join(chr(0x4E00 + random.Random(3).randrange(3000) + i % 7) for i in range(1_400_000))
ids, offsets = codec.encode([text])
assert codec.decode(ids, offsets) == [text]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert int(said.stdout) < 400  # MB for 4.2 MB of text
