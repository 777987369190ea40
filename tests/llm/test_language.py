import zlib

import numpy as np

from motorlake.llm import language


def test_held_out_accuracy(corpus):
    langs = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    rows = language.language_id(corpus).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 20 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_counts_match_a_plain_count():
    text = "Ab a-b\tÄb! 12 a"
    want = {}
    for word in ("ab", "a", "b", "äb", "a"):
        padded = f" {word} "
        for n in (2, 3):
            for i in range(len(padded) - n + 1):
                want[padded[i : i + n]] = want.get(padded[i : i + n], 0) + 1
        for c in word:
            want[c] = want.get(c, 0) + 1
    codes, counts = language.grams(text)

    def read(code):
        out = ""
        while code:
            out, code = chr(code & 0x1FFFFF) + out, code >> 21
        return out

    # a pair that ends one word and one that starts the next share the space between them
    assert {read(c): n for c, n in zip(codes.tolist(), counts.tolist())} == want


def test_long_texts_in_chunks(monkeypatch):
    texts = ["some words and more " * 50, "x" * 900, "ab" * 400 + "  --  " * 40 + "Σίσυφος ΣΑΣ", "1" * 500 + "a", "a" + " " * 500, ""]
    whole = [language.grams(t) for t in texts]
    for size in (1, 2, 3, 7, 200):
        monkeypatch.setattr(language, "CHUNK", size)
        for text, found in zip(texts, whole):
            for a, b in zip(found, language.grams(text)):
                assert np.array_equal(a, b)


def test_edges(documents):
    train = [(i, "the cat and the dog", "en") for i in range(40)] + [(i, "der hund und die katze", "de") for i in range(40, 80)]
    rows = documents([*train, (100, None, None), (101, "", None), (102, "123 !?", None), (103, "hund", None), (103, "hund", None), (104, "日本", None), (105, "dog", None)])
    got = [(r["doc_id"], r["lang_pred"]) for r in language.language_id(rows).collect() if r["doc_id"] >= 100]
    assert sorted(got) == [(100, "und"), (101, "und"), (102, "und"), (103, "de"), (103, "de"), (104, "de"), (105, "en")]
    assert language.language_id(rows.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.language_id(documents([(1, "no label", None)])).collect()} == {"und"}


def test_profiles_against_brute_force(documents):
    """Ranks and out-of-place distances by plain Python over a few texts."""
    train = {"en": ["the cat and the dog and the other dog", "this and that"], "de": ["der hund und die katze", "das und dieses und jenes"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]

    def ranked(*texts):
        counts = {}
        for t in texts:
            codes, n = language.grams(t)
            for c, k in zip(codes.tolist(), n.tolist()):
                counts[c] = counts.get(c, 0) + k
        return {c: r for r, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[:60])}

    profiles = language.fit_profiles(documents(rows), profile=60)
    want = {lang: ranked(*ts) for lang, ts in train.items()}
    assert profiles.langs == ["de", "en"]
    for text in ("the hound", "und der", "zebra", "and die"):
        own = ranked(text)
        far = {lang: sum(abs(r - known[c]) if c in known else 60 for c, r in own.items()) for lang, known in want.items()}
        best = min(sorted(far), key=far.get)
        assert language.predict(text, profiles, 60) == (best, 1 - far[best] / (60 * len(own)))


def test_clashing_columns(documents):
    rows = documents([(i, "the cat and the dog", "en") for i in range(8)])
    out = language.language_id(rows.selectExpr("*", "'own' as lang_pred", "'own' as score", "'own' as held_out"))
    assert {r["lang_pred"] for r in out.collect()} == {"en"}
