"""Quality rules: a threshold table compiled into one projection.

Native: DataFrame functions only, no shuffle and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlake.llm.common import fresh, let, words

#: Frequent function words by language. A corpus with other languages passes a table with theirs.
STOP_WORDS = {
    "en": "the of and to in that is was for with".split(),
    "de": "der die und den von zu das mit ist nicht".split(),
    "fr": "le la les de des et une dans que pour".split(),
    "es": "el los las y en por con una del se".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` is below ``low`` or above ``high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The method's threshold table.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=12),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.3),
    Rule("alpha_word_ratio", low=0.6),
    Rule("upper_ratio", high=0.5),
    Rule("bang_ratio", high=0.2),
)

WINDOW = 5


def repeated_words(ws: Column, n: int = WINDOW) -> Column:
    """How many words lie in windows of n words that the text holds twice or more, the first one included.

    Windows are told apart by 64 bits of hash; a sort of (hash, position) replaces comparing windows with each other.
    """
    hashes = F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))).otherwise(F.array().cast("array<bigint>"))

    def positions(ordered: Column) -> Column:
        same = lambda x, i, step: F.coalesce(F.get(ordered, i + step)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"]))

    def covered(pos: Column) -> Column:
        gaps = F.zip_with(F.slice(pos, F.lit(2), F.size(pos) - 1), F.slice(pos, F.lit(1), F.size(pos) - 1), lambda later, earlier: F.least(F.lit(n), later - earlier))
        return F.when(F.size(pos) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(n), lambda total, gap: total + gap))

    def counted(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, lambda o: let(positions(o), covered)))

    return let(hashes, counted).cast("bigint")


def measures(text: Column, stop_words: dict[str, list[str]] = STOP_WORDS) -> Column:
    """A struct of all counts of a text; null counts as a text without words."""
    stops = sorted({w for own in stop_words.values() for w in own})
    body = F.coalesce(text, F.lit(""))
    total = lambda ws, size: F.aggregate(ws, F.lit(0).cast("bigint"), lambda n, w: n + size(w))

    def of(x: Column) -> Column:
        ws, lines = x["w"], x["l"]
        counts = {
            "n_words": F.size(ws),
            "word_chars": total(ws, F.char_length),
            "n_symbols": F.regexp_count(x["t"], F.lit(r"[#*$%&|<>]")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(ws),
            "n_stop": F.size(F.filter(ws, lambda w: F.lower(w).isin(stops))),
            "n_alpha_words": F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))),
            "n_upper": F.regexp_count(x["t"], F.lit(r"\p{Lu}")),
            "n_bang_words": F.size(F.filter(ws, lambda w: w.endswith("!"))),
        }
        return F.struct(*[v.cast("bigint").alias(k) for k, v in counts.items()])

    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(body.alias("t"), words(text).alias("w"), lines.alias("l")), of)


def ratios(m: Column) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return {
        "n_words": m["n_words"],
        "mean_word_chars": share(m["word_chars"], m["n_words"]),
        "symbol_ratio": share(m["n_symbols"], m["n_words"]),
        "stop_ratio": share(m["n_stop"], m["n_words"]),
        "dup_line_ratio": share(m["n_dup_lines"], m["n_lines"]),
        "alpha_word_ratio": share(m["n_alpha_words"], m["n_words"]),
        "upper_ratio": share(m["n_upper"], m["word_chars"]),
        "bang_ratio": share(m["n_bang_words"], m["n_words"]),
    }


def failed(rule: Rule, metrics: dict[str, Column]) -> Column:
    value = metrics[rule.metric]
    tests = [value < rule.low] * (rule.low is not None) + [value > rule.high] * (rule.high is not None)
    return tests[0] | tests[1] if len(tests) == 2 else tests[0]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts, base_failed, kept, and failed_rules (array<string>, table order).

    base_failed: n_words < 10, or 100 * n_repeat_words > 20 * n_words, where windows count as
    equal if 64 bits of hash are. kept is false if base_failed, else true if no rule of the
    table fails. ``stop_words`` are words by language; texts in others have to pass without
    them, or a table without the rule. Null and empty texts have no words: base_failed.
    Repeated rows are judged alike; other columns pass through, those with the name of a
    result are replaced; empty tables give empty results.
    """
    held = fresh(docs, "measures")
    m = F.col(held)
    counted = docs.withColumn(held, measures(F.col("text"), stop_words))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    metrics = ratios(m)
    fails = F.array_compact(F.array(*[F.when(failed(r, metrics), F.lit(r.metric)) for r in rules]))
    return counted.withColumns({k: m[k] for k in names} | {"base_failed": base, "failed_rules": fails}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(held)
