import random
import time

import numpy as np
import pytest

from motorlake.llm.decontaminate import Items, allowed, edits, item_words, leaks, sections

WORDS = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300


def plain_edits(item, region):
    """The fewest edits from an item to a part of a region, by the full table."""
    row = [0] * (len(region) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(region, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    chance = random.Random(1)
    for _ in range(200):
        item = [chance.randrange(5) for _ in range(chance.randint(1, 80))]
        region = [chance.randrange(5) for _ in range(chance.randint(0, 120))]
        bits = {}
        for place, word in enumerate(item):
            bits[word] = bits.get(word, 0) | 1 << place
        assert edits(bits, len(item), region)[0] == plain_edits(item, region)


def edited(chance, words, n):
    out = list(words)
    for _ in range(n):
        at = chance.randrange(len(out))
        kind = chance.randrange(3)
        out[at : at + 1] = [[], [chance.choice(WORDS)], [out[at], chance.choice(WORDS)]][kind]
    return out


@pytest.mark.parametrize("sizes", [(5, 9), (10, 11), (12, 60), (61, 120)])
@pytest.mark.parametrize(("share", "recall"), [(0.0, 1.0), (0.1, 0.98), (0.2, 0.9)])
def test_recall_of_edited_items(share, recall, sizes):
    chance = random.Random(7)
    rows = [(i, " ".join(chance.choice(WORDS) for _ in range(chance.randint(*sizes)))) for i in range(60)]
    items = Items(rows)
    documents, planted = [], set()
    for d in range(240):
        item = item_words(rows[d % 60][1])
        body = [chance.choice(WORDS) for _ in range(200)]
        at = chance.randrange(200)
        body[at:at] = edited(chance, item, int(len(item) * share))
        documents.append(body)
        if plain_edits(item, body) <= allowed(len(item)):
            planted.add((d, d % 60))
    found = {(d, n) for d, n, _, _ in items.search(documents)}
    assert len(found & planted) >= recall * len(planted)
    for d, n in found:
        assert plain_edits(item_words(rows[n][1]), documents[d]) <= allowed(len(item_words(rows[n][1])))


def test_clean_documents_are_left_alone():
    chance = random.Random(9)
    items = Items([(i, " ".join(chance.choice(WORDS) for _ in range(30))) for i in range(50)])
    assert items.search([[chance.choice(WORDS) for _ in range(500)] for _ in range(100)]) == []


def test_rows(spark, documents):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "too short"), (1, passage)], "item_id bigint, text string")
    rows = documents([(1, f"before it {passage.upper()} and after"), (2, passage.replace("five", "FIVE!")), (3, None), (4, ""), (5, passage.replace("five", "5").replace("nine", "9")), (6, passage.replace("one two three four five", "")), (7, "too short"), (None, passage), (1, f"before it {passage.upper()} and after")])
    got = sorted((r["doc_id"] or -1, r["item_id"], r["distance"]) for r in leaks(rows, bench).collect())
    assert got == sorted([(-1, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (5, 1, 2)] * 2 + [(7, 4, 0)])
    assert {r["doc_id"] for r in leaks(rows, bench, min_words=5).collect()} == {None, 1, 2, 5}
    assert leaks(rows.limit(0), bench).count() == 0 and leaks(rows, bench.limit(0)).count() == 0


def test_passes(spark, documents, monkeypatch):
    chance = random.Random(3)
    texts = [" ".join(chance.choice(WORDS) for _ in range(20)) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    rows = documents(list(enumerate(texts)))
    monkeypatch.setattr("motorlake.llm.decontaminate.PASS_CHARS", 300)
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(rows, bench).collect()) == [(i, i) for i in range(12)]


def test_corpus_against_every_pair(spark, corpus, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r["item_id"], item_words(r["text"])) for r in bench.collect()]
    want = set()
    for r in corpus.collect():
        words = item_words(r["text"])
        seen = set(words)
        for i, item in items:
            if sum(w in seen for w in item) >= len(item) - allowed(len(item)):
                if plain_edits(item, words) <= allowed(len(item)):
                    want.add((r["doc_id"], i))
    assert {(r["doc_id"], r["item_id"]) for r in leaks(corpus, bench).collect()} == want


@pytest.mark.parametrize("size", [120, 480, 1000])
def test_recall_of_long_items(size):
    chance = random.Random(size)
    vocabulary = [f"w{i}" for i in range(20000)]
    rows = [(i, " ".join(chance.choice(vocabulary) for _ in range(size))) for i in range(12)]
    documents = []
    for i, text in rows:
        words = item_words(text)
        if i % 3:
            for _ in range(allowed(size)):
                at = chance.randrange(len(words))
                words[at : at + 1] = [[], [chance.choice(vocabulary)], [words[at], chance.choice(vocabulary)]][chance.randrange(3)]
        else:  # every section has its share
            words[2::5] = ["other"] * len(words[2::5])
        documents.append([chance.choice(vocabulary) for _ in range(60)] + words + [chance.choice(vocabulary) for _ in range(60)])
    found = {(d, n): e for d, n, e, _ in Items(rows).search(documents)}
    assert sorted(found) == [(i, i) for i in range(12)]
    assert max(found.values()) <= allowed(size)
    assert found[0, 0] == plain_edits(item_words(rows[0][1]), documents[0])


def test_sections():
    assert sections(40) == [(0, 40)] and sections(41) == [(0, 20), (20, 21)]
    for length in (5, 39, 100, 1001):
        assert [p for a, n in sections(length) for p in range(a, a + n)] == list(range(length))


def test_shortened_item_at_the_end():
    item = [f"w{i}" for i in range(12)]
    items = Items([(0, " ".join(item))])
    short = item[:4] + item[5:9] + item[10:]
    for before in ([], [["other"] * 30], [short, ["other"]]):
        found = [(d, e) for d, _, e, _ in items.search([*before, short])]
        assert found[-1:] == [(len(before), 2)]


def test_short_items_are_found_word_by_word():
    items = Items([(0, "w1"), (1, "w1 w2"), (2, "w5 w5 w6"), (3, "w7 w8 w9 w10"), (4, "..."), (5, None)])
    documents = [["w1"], ["w2", "w1"], ["w0", "w1", "w2"], ["w5", "w5", "w5", "w6"], ["w7", "w8", "w9"], ["w7", "w8", "w9", "w10", "x"], ["w5", "w6"], []]
    assert sorted((d, n, e) for d, n, e, _ in items.search(documents)) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 2, 0), (5, 3, 0)]


def test_long_texts_and_clashing_columns(spark, documents):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, passage, "own")], "item_id bigint, text string, doc_id string")
    rows = documents([(1, "word " * 600_000 + passage + " more" * 600_000), (2, "word " * 600_000)])
    found = leaks(rows.selectExpr("*", "'own' as item_id", "'own' as distance"), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["end_word"]) for r in found] == [(1, 1, 600_012)]


def shared(n, rng):
    """Items with one section of words in common."""
    word = lambda: f"w{rng.integers(0, 4000)}"
    head = [word() for _ in range(40)]
    return head, [(i, " ".join([*head, *(word() for _ in range(40))])) for i in range(n)]


def test_sections_that_many_items_share():
    """A document with the common section alone holds no item; one with an item's own words holds that one, whatever else shares its section."""
    rng = np.random.default_rng(8)
    head, rows = shared(1000, rng)
    items = Items(rows)
    noise = [f"w{x}" for x in rng.integers(0, 4000, 300)]
    documents = [[*noise, *head, *noise] for _ in range(30)]
    began = time.perf_counter()
    assert items.search(documents) == []
    assert time.perf_counter() - began < 20
    whole = rows[17][1].split()
    edited = [w if i % 8 else "other" for i, w in enumerate(rows[400][1].split())]
    assert [(d, n) for d, n, _, _ in items.search([[*noise, *whole, *noise], [*noise, *edited], [*head, *whole[40:]], [*head, *noise]])] == [(0, 17), (1, 400), (2, 17)]


def test_equal_items_are_all_told():
    text = " ".join(f"w{i}" for i in range(100))
    assert [(d, n, e) for d, n, e, _ in Items([(5, text), (6, text), (7, text + " more")]).search([["x", *text.split(), "y"]])] == [(0, 0, 0), (0, 1, 0), (0, 2, 1)]
