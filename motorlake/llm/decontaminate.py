"""Benchmark decontamination: documents that hold a benchmark item up to a share of edited words.

Windows of an item's length are embedded by the CGK random walk, which turns edits
into few differing places; samples of places are keys of hash tables that hold the
items. A long item is cut into sections of nearly equal length: of all its edits, one
section holds no more than its share, so recall doesn't fall with the item's length.
What meets in a table is verified by the exact edit distance in words of the whole item.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlake.llm.arrow import mapper, texts

#: An item counts as held if at most (1 - SIMILARITY) of its words are edited.
SIMILARITY = 0.8
#: Items of fewer words are left out; the corpus pipeline asks for five.
MIN_WORDS = 1
#: Words in a section of an item at most.
SECTION_WORDS = 40
#: Random walks, samples of each, and places in a sample.
WALKS = 8
SAMPLES = 12
PLACES = 3
#: Benchmark text handled in one pass over the documents, in characters; more takes more passes.
PASS_CHARS = 16 << 20
#: Windows embedded at once.
CHUNK = 1 << 17

WORD = re.compile(r"\w+")


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(length: int, similarity: float = SIMILARITY) -> int:
    return int(length * (1 - similarity) + 1e-9)


def sections(length: int, most: int | None = None) -> list[tuple[int, int]]:
    """(offset, length) of the sections of an item, SECTION_WORDS long at most; their lengths differ by one at most."""
    n = -(-length // (most or SECTION_WORDS))
    bounds = [i * length // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def edits(item: dict[int, int], length: int, region: list[int]) -> tuple[int, int]:
    """(distance, end): the fewest edits that turn an item into a part of ``region``, and where the first such part ends.

    Bit-parallel: ``item`` maps a word to the bits of its places in the item.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for at, word in enumerate(region):
        eq = item.get(word, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = minus | ~(d0 | plus) & full, plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = hn | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, end = score, at + 1
    return best, end


class Items:
    """The sections of benchmark items in hash tables, one set of tables for each window length."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS, seed: int = 11) -> None:
        kept = [(i, w) for i, w in ((i, item_words(t)) for i, t in rows) if len(w) >= max(1, min_words)]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
        self.unknown = len(self.vocabulary)
        self.ids = [i for i, _ in kept]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in kept]
        self.allowed = [allowed(len(w), similarity) for w in self.words]
        self.bits: list[dict[int, int]] = []
        for ws in self.words:
            bits: dict[int, int] = defaultdict(int)
            for place, w in enumerate(ws.tolist()):
                bits[w] |= 1 << place
            self.bits.append(dict(bits))
        self.sections: list[list[tuple[int, int]]] = []  # (item, offset) of all places of each different section
        shares: list[int] = []
        by_length: dict[int, list[int]] = defaultdict(list)
        numbers: dict[bytes, int] = {}
        for n, ws in enumerate(self.words):
            for offset, size in sections(len(ws)):
                number = numbers.setdefault(ws[offset : offset + size].tobytes(), len(self.sections))
                if number == len(self.sections):
                    by_length[size].append(number)
                    self.sections.append([])
                    shares.append(allowed(size, similarity))
                self.sections[number].append((n, offset))
        self.places = [self._places(held) for held in self.sections]
        chance = np.random.default_rng(seed)
        longest = 2 * max(by_length, default=1)
        self.odd = chance.integers(1, 1 << 63, (WALKS, longest), np.uint64) | np.uint64(1)
        self.mix = chance.integers(1, 1 << 63, PLACES, np.uint64) | np.uint64(1)
        self.classes = []
        for length, members in sorted(by_length.items()):
            member_words = np.stack([self.words[n][offset : offset + length] for n, offset in (self.sections[m][0] for m in members)])
            known = np.zeros(self.unknown + 2, bool)
            known[member_words.ravel()] = True
            samples = [[np.sort(chance.choice(2 * length, min(PLACES, 2 * length), replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
            spare = np.array([shares[m] for m in members])
            flat, starts = member_words.ravel(), np.arange(len(members)) * length
            tables = []
            for keys in self.keys(flat, starts, length, samples):
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], np.array(members)[order]))
            self.classes.append((length, known, member_words, spare, samples, tables))

    def _places(self, held: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Of the items that share a section: their numbers, the section's offsets, their sizes and allowed edits."""
        n, offset = (np.array(x, np.int64) for x in zip(*held, strict=True))
        return n, offset, np.array([len(self.words[i]) for i in n]), np.array([self.allowed[i] for i in n])

    def possible(self, symbols: np.ndarray, low: int, high: int, section: int, start: int) -> list[tuple[int, int]]:
        """(item, start) of the items behind a section that the words from ``low`` to ``high`` may hold: a word of an item that isn't there costs an edit."""
        n, offset, size, allowed_ = self.places[section]
        if len(n) > 1:
            there = np.zeros(self.unknown + 2, bool)
            there[symbols[low:high]] = True
            missing = np.add.reduceat(~there[np.concatenate([self.words[i] for i in n])], np.cumsum(size) - size, dtype=np.int64)
            keep = missing <= allowed_
            n, offset = n[keep], offset[keep]
        return list(zip(n.tolist(), (start - offset).tolist(), strict=True))

    def keys(self, symbols: np.ndarray, starts: np.ndarray, length: int, samples: list) -> list[np.ndarray]:
        """The sample keys of the embedded windows: SAMPLES arrays for each walk."""
        out = []
        pad = self.unknown + 1
        for walk in range(WALKS):
            wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for s, chosen in enumerate(samples[walk]):
                for k, place in enumerate(chosen.tolist()):
                    wanted[place].append((s, k))
            keys = np.zeros((SAMPLES, len(starts)), np.uint64)
            at = np.zeros(len(starts), np.int64)
            for step in range(max(wanted) + 1):
                word = np.where(at < length, symbols[np.minimum(starts + at, len(symbols) - 1)], pad)
                for s, k in wanted.get(step, ()):
                    keys[s] += (word.astype(np.uint64) + np.uint64(1)) * self.mix[k]
                turn = ((word.astype(np.uint64) + np.uint64(1)) * self.odd[walk, step % self.odd.shape[1]]) >> np.uint64(63)
                at += turn.astype(np.int64)
            out += list(keys)
        return out

    def windows(self, symbols: np.ndarray, frequency: np.ndarray, length: int, known: np.ndarray, member_words: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """Starts of the windows that can be close enough to a section; no other window is.

        Of any k + 1 words of a section at least one is left by k edits, so a window holds one
        of each section's rarest k + 1 words here; and it holds all but k words of a section.
        """
        rarest = np.argsort(frequency[member_words], axis=1, kind="stable")[:, : spare.max() + 1]
        picked = np.take_along_axis(member_words, rarest, axis=1)[np.arange(rarest.shape[1]) <= spare[:, None]]
        anchor = np.zeros(len(known), bool)
        anchor[picked] = True
        at, last = np.flatnonzero(anchor[symbols]), max(0, len(symbols) - length)
        if not len(at):
            return at
        if len(at) * length < len(symbols):
            starts = np.unique(np.clip(at[:, None] - np.arange(length), 0, last))
        else:
            anchors = np.concatenate(([0], np.cumsum(anchor[symbols], dtype=np.int32)))
            starts = np.arange(last + 1)
            starts = starts[anchors[np.minimum(starts + length, len(symbols))] > anchors[starts]]
        seen = np.concatenate(([0], np.cumsum(known[symbols], dtype=np.int32)))
        return starts[seen[np.minimum(starts + length, len(symbols))] - seen[starts] >= length - spare.max()]

    def candidates(self, symbols: np.ndarray):
        """(start, section) of windows that meet a section in a table."""
        frequency = np.bincount(symbols, minlength=self.unknown + 2)
        for length, known, member_words, spare, samples, tables in self.classes:
            starts = self.windows(symbols, frequency, length, known, member_words, spare)
            for at in range(0, len(starts), CHUNK):
                part = starts[at : at + CHUNK]
                found = []
                for (ordered, members), keys in zip(tables, self.keys(symbols, part, length, samples), strict=True):
                    low, high = np.searchsorted(ordered, keys, "left"), np.searchsorted(ordered, keys, "right")
                    for w in np.flatnonzero(high > low):
                        found += [(int(part[w]), int(m)) for m in members[low[w] : high[w]]]
                yield from set(found)

    def search(self, documents: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(document, item, distance, end in words): the closest part of each document for each item that it holds."""
        get, unknown, pad = self.vocabulary.get, self.unknown, self.unknown + 1
        symbols, bounds = [], [0]
        for words in documents:
            symbols += [get(w, unknown) for w in words]
            symbols.append(pad)  # between documents
            bounds.append(len(symbols))
        symbols += [pad] * max((length for length, *_ in self.classes), default=0)  # so that a window can start at every word
        symbols, bounds = np.array(symbols, np.int64), np.array(bounds)
        regions: dict[tuple[int, int], list[int]] = defaultdict(list)
        met: dict[tuple[int, int], list[int]] = defaultdict(list)
        for start, section in self.candidates(symbols):
            met[int(np.searchsorted(bounds, start, "right")) - 1, section].append(start)
        for (document, section), starts in met.items():
            _, offset, size, allowed_ = self.places[section]
            before, behind = int((offset + 2 * allowed_).max()), int((size - offset + 2 * allowed_).max())
            # starts close to each other share the words around them
            starts = sorted(set(starts))
            cuts = [0, *(i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > behind), len(starts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                low, high = max(starts[a] - before, int(bounds[document])), min(starts[b - 1] + behind, int(bounds[document + 1]))
                for n, at in self.possible(symbols, low, high, section, 0):
                    regions[document, n] += [at + start for start in starts[a:b]]
        out = []
        for (document, n), starts in sorted(regions.items()):
            size, k = len(self.words[n]), self.allowed[n]
            slack = k if size <= SECTION_WORDS else 2 * k  # the words before a section may be edited too
            best = (size + 1, 0)
            low = high = None
            for start in [*sorted(set(starts)), None]:
                if start is not None and low is not None and start - slack <= high:
                    high = max(high, start + size + slack)
                    continue
                if low is not None:
                    first, last = max(low, int(bounds[document])), min(high, int(bounds[document + 1]) - 1)
                    distance, end = edits(self.bits[n], size, symbols[first:last].tolist())
                    best = min(best, (distance, first + end - int(bounds[document])))
                if start is not None:
                    low, high = start - slack, start + size + slack
            if best[0] <= k:
                out.append((document, n, *best))
        return out


SCHEMA = "doc_id bigint, item_id bigint, distance int, item_words int, similarity double, end_word bigint"


def _passes(benchmark: DataFrame, similarity: float, min_words: int):
    """The benchmark's items, ready for the tasks, in passes of PASS_CHARS characters at most."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = -(-size // PASS_CHARS)
    for turn in range(passes):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == turn).orderBy("item_id", "text").collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(Items(rows, similarity, min_words))


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns; what holds one is said at leaks(). Nothing is shuffled."""
    for sent in _passes(benchmark, similarity, min_words):

        def step(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            clean = np.ones(batch.num_rows, bool)
            clean[[d for d, *_ in sent.value.search([item_words(t) for t in texts(batch)])]] = False
            return batch.filter(pa.array(clean))

        docs = docs.mapInArrow(mapper(step), docs.schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document and benchmark item that it holds; clean documents have none.

    A document holds an item if a run of its words is at most (1 - ``similarity``) of the
    item's words away in edits. Words are runs of letters, digits and underscores in lower
    case. An item of fewer than five words has to be there word by word: an equal window has
    equal keys in all tables, so none is missed. Items of fewer than ``min_words`` words, items
    without words and null texts hold nothing. Whole texts are searched, however long. Repeated
    rows of either table give rows each. Other columns aren't read, so they can't clash; empty
    tables give no rows.
    The benchmark goes to all tasks in passes of PASS_CHARS characters at most.
    """
    documents = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    found = None
    for sent in _passes(benchmark, similarity, min_words):

        def step(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            held = sent.value
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[d], held.ids[n], e, len(held.words[n]), 1 - e / len(held.words[n]), end) for d, n, e, end in held.search([item_words(t) for t in texts(batch)])]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "item_words", "similarity", "end_word"])

        own = documents.mapInArrow(mapper(step), SCHEMA)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else documents.sparkSession.createDataFrame([], SCHEMA)
