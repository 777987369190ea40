"""Language ID by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams. A document's most
frequent n-grams are compared to each profile: every n-gram counts the distance
between its two ranks, or the largest distance if the profile lacks it; the language
with the smallest sum wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from motorlake.llm.arrow import mapper, texts

#: Length of a language's profile, and of a document's.
PROFILE = 400
#: The profiles are fitted on about so many labelled documents of each language, chosen by a hash of doc_id.
TRAINING_DOCS = 5_000
UNDETERMINED = "und"
#: Characters counted at once.
CHUNK = 1 << 18
SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(lowered: str, carry: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 characters that end in a part of a lower-cased text, 21 bits for each character, and what the next part has to carry on.

    All but letters are spaces, and several of these one; a text has one on either side.
    """
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    seen = np.concatenate((carry, np.where(_letters()[points], points, SPACE), [SPACE] if last else []))
    seen = seen[np.concatenate(([True], (seen[1:] != SPACE) | (seen[:-1] != SPACE)))].astype(np.int64)
    before = len(carry)
    pairs = seen[:-1] << 21 | seen[1:]
    triples = pairs[:-1] << 21 | seen[2:]
    own = seen[before:]
    codes = (own[own != SPACE], pairs[before - 1 :], triples[max(0, before - 2) :][seen[1:-1][max(0, before - 2) :] != SPACE])
    return np.concatenate(codes), seen[-2:]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, ascending, and how often each occurs; counted CHUNK characters at a time, those across the cuts too."""
    lowered, carry, found = text.lower(), np.array([SPACE]), []
    for at in range(0, len(lowered), CHUNK):
        codes, carry = _codes(lowered[at : at + CHUNK], carry, at + CHUNK >= len(lowered))
        found.append(np.unique(codes, return_counts=True))
    return merged(found) if len(found) != 1 else found[0]


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, places = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(places, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of (lang, text); summed within each batch before the shuffle."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            by_lang.setdefault(lang, []).append(grams(text))
        totals = {lang: merged(found) for lang, found in by_lang.items()}
        names = [lang for lang, (codes, _) in totals.items() for _ in range(len(codes))]
        columns = [np.concatenate([np.zeros(0, np.int64), *(t[i] for t in totals.values())]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, columns)], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(mapper(step), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Profiles:
    """langs in ascending order; grams ascending; ranks has a row for each gram with its rank in each language, PROFILE where that lacks it."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def fit_profiles(labelled: DataFrame, training_docs: int = TRAINING_DOCS, profile: int = PROFILE) -> Profiles:
    """Fit on (doc_id, lang, text) rows with a lang: on all of them, or on a hash sample of about ``training_docs`` a language where it has more."""
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, training_docs / n))) for lang, n in sorted(counts.items())], F.lit(0.0)) if counts else F.lit(0.0)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = gram_counts(chosen).withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < profile).collect()  # PROFILE rows for each language
    langs = sorted({r["lang"] for r in top})
    known = np.unique(np.array([r["gram"] for r in top], np.int64))
    ranks = np.full((len(known), len(langs)), profile, np.int64)
    for r in top:
        ranks[np.searchsorted(known, r["gram"]), langs.index(r["lang"])] = r["rank"]
    return Profiles(langs, known, ranks)


def predict(text: str, profiles: Profiles, profile: int = PROFILE) -> tuple[str, float]:
    """The language and the score of a text; of equally frequent n-grams the one with the smaller code ranks first. Undetermined where there is no letter, or no profile was learned."""
    codes, counts = grams(text)
    if not len(codes) or not profiles.langs:
        return UNDETERMINED, 0.0
    own = codes[np.argsort(-counts, kind="stable")[:profile]]
    places = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    found = profiles.grams[places] == own
    ranks = profiles.ranks[places[found]]
    far = np.where(ranks == profile, profile, np.abs(ranks - np.flatnonzero(found)[:, None])).sum(axis=0) + profile * int((~found).sum())
    best = int(np.argmin(far))
    return profiles.langs[best], float(1 - far[best] / (profile * len(own)))


def identify(docs: DataFrame, profiles: Profiles, profile: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more, ``names``: the language of each row's text, and a score. The texts aren't shuffled.

    The language is one of the profiles, or ``und`` if the text is null or has no letter,
    or if nothing was learned. score is 1 minus the distance as a share of the largest
    possible one; ties go to the first language in order. Whole texts are read, however
    long. Repeated rows get equal results; an empty table gives none. Columns with one of
    the names are replaced.
    """
    docs = docs.drop(*names)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [predict(t, profiles, profile) for t in texts(batch)]
        more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(mapper(step), schema)


def held_out() -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text leaves 2 modulo 4. A null id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows that aren't held out, then identify all: doc_id, held_out, lang_pred, score. Other columns than doc_id, text and lang aren't read."""
    profiles = fit_profiles(docs.where(~held_out()))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return identify(own, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
