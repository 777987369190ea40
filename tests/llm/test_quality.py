import re
from collections import Counter

from pyspark.sql import functions as F

from motorlake.llm.quality import Rule, quality

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(words) < 10 or 100 * len(marked) > 20 * len(words))


def test_corpus(corpus):
    for r in quality(corpus).collect():
        assert tuple(r[n] for n in NAMES) == brute(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_edges(documents):
    cases = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "a " * 5000, "x y z w v " * 3 + "q", "l\nl\n l\nl", "#$%&|<>*", "é" * 10, "a b c"]
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in quality(documents(list(enumerate(cases)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(cases)}


def test_rules_are_one_projection(documents):
    out = quality(documents([(1, "the cat and the dog sat on a mat in the sun today")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    row = out.first()
    assert row["kept"] and row["failed_rules"] == []


def test_own_rules(documents):
    rows = documents([(1, "one two three four five six seven eight nine ten eleven")])
    assert quality(rows, (Rule("n_words", high=5),)).first()["failed_rules"] == ["n_words"]


def test_clashing_columns_and_empty(documents):
    rows = documents([(1, "a b")]).withColumn("kept", F.lit("mine")).withColumn("w", F.lit(3))
    assert quality(rows).first()["kept"] is False
    assert quality(rows.limit(0)).count() == 0
