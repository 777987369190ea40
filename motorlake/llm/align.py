"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text, and how often over the corpus.

Texts are encoded once, slice by slice. The distinct links of a slice are packed by
stripe (A id modulo ``STRIPES``) and stored. A stripe of the count matrix is a dense block
of its A ids by all B ids, so its size is bounded by the vocabularies: tasks combine their
slices' links first, ``np.add.at`` sums what they send into the block, and row maxima give
the best counts. The links then meet the block of their own stripe, dealt out by stripe
and salt, and what they score is summed for each slice.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlake.llm.arrow import slices, texts
from motorlake.llm.common import stored
from motorlake.llm.vocabulary import tokenizer_file

#: Blocks of the count matrix; with 50 257 x 32 000 ids, one has 393 rows and 100 MB at most.
STRIPES = 128
#: Bytes of text encoded at once, links combined at once, and cells of a block in one row.
SLICE = 2 << 20
COMBINED = 4 << 20
CELLS = 1 << 20
#: The byte-pair library can't take longer runs of white space; the other library encodes such texts.
LONG_WHITE = re.compile(r"\s{256}")

DOC_FIELDS = "doc_id bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
ENCODED = f"kind int, slice bigint, stripe int, {DOC_FIELDS}, docs binary, cells binary, counts binary"
DOC_NAMES = [x.split()[0] for x in DOC_FIELDS.split(", ")]


@dataclass(frozen=True)
class Files:
    """Vocabulary files: A as a byte-level BPE with its ranks, B as a piece model."""

    entries: str
    ranks: str
    pieces: str


def public_files() -> Files:
    return Files(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model"))


def _visible() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both encoders with the bytes of each of their ids."""

    def __init__(self, files: Files) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        import base64
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.files = files
        with open(files.ranks, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        visible = _visible()
        with open(files.entries, encoding="utf-8") as text:
            held = json.load(text)
        vocabulary = held["model"]["vocab"] | {x["content"]: x["id"] for x in held["added_tokens"]}
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.a[i] = bytes(visible[c] for c in word) if all(c in visible for c in word) else word.encode()
        self.b = [self._piece(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        self.a_names, self.b_names = self._names(len(self.a), ",|"), self._names(len(self.b), ",;\n")

    @staticmethod
    def _piece(piece: str) -> bytes:
        found = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    @staticmethod
    def _names(n: int, marks: str) -> np.ndarray:
        """Decimal ids, all of them before each of ``marks``."""
        return np.array([f"{i}{mark}" for mark in marks for i in range(n)], dtype=object)

    @cached_property
    def whole(self):
        """Loaded for the first text that the byte-pair library can't take."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.files.entries)
        out.encode_special_tokens = True
        return out

    def encode_a(self, text: str) -> np.ndarray:
        if LONG_WHITE.search(text):
            return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def encode_b(self, many: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.pieces.encode(many, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers(files: Files) -> Tokenizers:
    return Tokenizers(files)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Aligned:
    """Texts of a slice that both sides give back byte by byte: their ids, and where tokens and documents end among all their bytes."""

    places: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    doc_ends: np.ndarray

    def marks(self, ends: np.ndarray) -> np.ndarray:
        """Which bytes are the last of something; all tokens have at least one."""
        out = np.zeros(int(self.doc_ends[-1]), bool)
        out[ends - 1] = True
        return out


def before(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked bytes lie before the last one of each of ``ends``."""
    return np.cumsum(marks, dtype=np.int64)[ends - 1] - marks[ends - 1]


def aligned(own: Tokenizers, many: list[str]) -> Aligned:
    """Encode by both sides and keep the texts that are whole on both; empty ones have no tokens."""
    chosen = [i for i, x in enumerate(many) if x]
    firsts = [own.encode_a(" " + many[i]) for i in chosen]
    seconds = own.encode_b([many[i] for i in chosen])
    places, a, b, sizes = [], [], [], []
    for i, x, y in zip(chosen, firsts, seconds, strict=True):
        want = b" " + many[i].encode()
        if own.a_sizes[x].sum() == own.b_sizes[y].sum() == len(want) and b"".join(map(own.a.__getitem__, x.tolist())) == want == b"".join(map(own.b.__getitem__, y.tolist())):
            places.append(i)
            a.append(x)
            b.append(y)
            sizes.append(len(want))
    a_ids, b_ids = _joined(a), _joined(b)
    return Aligned(np.array(places, np.int64), a_ids, b_ids, np.cumsum(own.a_sizes[a_ids]), np.cumsum(own.b_sizes[b_ids]), np.cumsum(np.array(sizes, np.int64)))


def links(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, A id, B id) of each overlap of two tokens: every stretch between two ends lies in one token of each side."""
    a, b = found.marks(found.a_ends), found.marks(found.b_ends)
    ends = np.flatnonzero(a | b) + 1
    return before(found.marks(found.doc_ends), ends), found.a[before(a, ends)], found.b[before(b, ends)]


def group_texts(own: Tokenizers, found: Aligned) -> tuple[np.ndarray, list[str]]:
    """The document of each group, and each document's groups as text."""
    both, docs = found.marks(found.a_ends) & found.marks(found.b_ends), found.marks(found.doc_ends)
    common = np.flatnonzero(both) + 1
    in_a, in_b = before(both, found.a_ends), before(both, found.b_ends)
    up_to_a, up_to_b = np.cumsum(np.bincount(in_a, minlength=len(common))), np.cumsum(np.bincount(in_b, minlength=len(common)))
    i, j = np.arange(len(in_a)), np.arange(len(in_b))
    last_a, last_b = i + 1 == up_to_a[in_a], j + 1 == up_to_b[in_b]
    parts = np.empty(len(i) + len(j), object)
    parts[i + np.concatenate([[0], up_to_b])[in_a]] = own.a_names[found.a + len(own.a) * last_a]
    parts[j + up_to_a[in_b]] = own.b_names[found.b + len(own.b) * (last_b.astype(np.int64) + docs[found.b_ends - 1])]
    return before(docs, common), "".join(parts.tolist()).split("\n")[:-1]


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _rows(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    n = max(len(x) for x in columns.values() if isinstance(x, list | np.ndarray))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x := columns.get(f.name), list | np.ndarray) else pa.nulls(n, f.type) if x is None else pa.array([x] * n, f.type) for f in schema], schema=schema)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def encode(docs: DataFrame, files: Files) -> DataFrame:
    """Rows of kind 0 for documents, and of kind 1 for the distinct links of a slice in a stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema, task, count = tokenizers(files), _schema(ENCODED), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                number = (task << 32) | count
                count += 1
                found = aligned(own, texts(part))
                n, size = part.num_rows, len(found.places)
                counts = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
                digests = [""] * n
                if size:
                    doc, a, b = links(found)
                    of_group, names = group_texts(own, found)
                    docs_end = found.marks(found.doc_ends)
                    for name, of in (("n_a", before(docs_end, found.a_ends)), ("n_b", before(docs_end, found.b_ends)), ("n_groups", of_group), ("n_links", doc)):
                        counts[name][found.places] = np.bincount(of, minlength=size)
                    for place, text in zip(found.places.tolist(), names, strict=True):
                        digests[place] = hashlib.sha256(text.encode()).hexdigest()
                yield _rows(schema, {"kind": 0, "slice": number, "doc_id": part.column("doc_id").to_pylist(), "place": np.arange(n), **counts, "groups_sha256": digests})
                if size:
                    width = len(own.b)
                    keys, times = np.unique((doc * len(own.a) + a) * width + b, return_counts=True)
                    rest, b = np.divmod(keys, width)
                    doc, a = np.divmod(rest, len(own.a))
                    stripe = (a % STRIPES).astype(np.int16)
                    order = np.argsort(stripe, kind="stable")
                    columns = [_packed(x[order]) for x in (found.places[doc], a // STRIPES * width + b, times)]
                    cuts = np.searchsorted(stripe[order], np.arange(STRIPES + 1)) * 4
                    full = np.flatnonzero(np.diff(cuts)).tolist()
                    packed = [[x[cuts[k] : cuts[k + 1]] for k in full] for x in columns]
                    yield _rows(schema, {"kind": 1, "slice": number, "stripe": full, "docs": packed[0], "cells": packed[1], "counts": packed[2]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def _u4(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4")


CELL_ROWS = "stripe int, cells binary, counts binary"


def _cell_rows(stripe: int, cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = _schema(CELL_ROWS)
    for at in range(0, len(cells), CELLS):
        yield _rows(schema, {"stripe": [stripe], "cells": [_packed(cells[at : at + CELLS])], "counts": [counts[at : at + CELLS].astype("<i8").tobytes()]})


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the links of a task's slices before they are sent."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for stripe in sorted(held):
            cells, documents = np.unique(np.concatenate(held[stripe]), return_counts=True)
            yield from _cell_rows(stripe, cells, documents)
        held.clear()

    for batch in batches:
        for stripe, cells in zip(batch.column("stripe").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            held.setdefault(stripe, []).append(_u4(cells))
            size += len(cells) // 4
            if size >= COMBINED:
                yield from flush()
                size = 0
    yield from flush()


def _stripes(rows: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum sorted rows of cells into a dense block for each stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for stripe, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "cells", "counts")), strict=True):
                if stripe != now:
                    if block is not None:
                        full = np.flatnonzero(block)
                        yield from _cell_rows(now, full, block[full])
                    now, block = stripe, np.zeros(rows * width, np.int64)
                np.add.at(block, _u4(cells), np.frombuffer(counts, "<i8"))
        if block is not None:
            full = np.flatnonzero(block)
            yield from _cell_rows(now, full, block[full])

    return run


def salts(df: DataFrame) -> int:
    """Tasks for each stripe: one, or more where the session has more shuffle partitions than stripes."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // STRIPES)


def matrices(encoded: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(stripe, cells, counts): in how many documents each pair of ids is linked, cell by cell of each stripe's block."""
    add, many = _stripes(*shape), salts(encoded)
    sent = encoded.where("kind = 1").select("stripe", "cells").mapInArrow(_combine, CELL_ROWS)
    if many > 1:
        salted = sent.withColumn("salt", F.xxhash64("cells") % many)
        sent = salted.repartition(STRIPES * many, "stripe", "salt").sortWithinPartitions("stripe", "salt").drop("salt").mapInArrow(add, CELL_ROWS)
    return stored(sent.repartition(STRIPES, "stripe").sortWithinPartitions("stripe").mapInArrow(add, CELL_ROWS), "align-matrices")


SCORES = "slice bigint, docs binary, n_best binary, count_sum binary"


def _score(rows: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by stripe, salt and kind: a stripe's cells first, each in one row, then links of that stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, block, best = _schema(SCORES), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for key, kind, number, docs, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "slice", "docs", "cells", "counts")), strict=True):
                if key != now:
                    now, block, best = key, np.zeros(rows * width, np.int64), np.zeros(rows, np.int64)
                if kind == 0:
                    at, value = _u4(cells), np.frombuffer(counts, "<i8")
                    np.add.at(block, at, value)
                    np.maximum.at(best, at // width, value)
                    continue
                at, times = _u4(cells), _u4(counts).astype(np.int64)
                value = block[at]
                own, first = np.unique(_u4(docs), return_index=True)  # sorted already
                n_best = np.add.reduceat(times * (value == best[at // width]), first)
                yield _rows(schema, {"slice": [number], "docs": [_packed(own)], "n_best": [n_best.astype("<i8").tobytes()], "count_sum": [np.add.reduceat(times * value, first).astype("<i8").tobytes()]})

    return run


TOTALS = "slice bigint, place int, n_best bigint, count_sum bigint"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the scores of each slice; rows come sorted by slice, and a slice has at most STRIPES of them for each salt."""
    schema, now = _schema(TOTALS), None
    sums: np.ndarray = np.zeros((2, 0), np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield _rows(schema, {"slice": now, "place": np.arange(sums.shape[1]), "n_best": sums[0], "count_sum": sums[1]})

    for batch in batches:
        for number, docs, n_best, count_sum in zip(*(batch.column(c).to_pylist() for c in ("slice", "docs", "n_best", "count_sum")), strict=True):
            if number != now:
                yield from told()
                now, sums = number, np.zeros((2, 0), np.int64)
            places = _u4(docs)
            if places[-1] >= sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, int(places[-1]) + 1 - sums.shape[1])))
            sums[0, places] += np.frombuffer(n_best, "<i8")
            sums[1, places] += np.frombuffer(count_sum, "<i8")
    yield from told()


def scores(encoded: DataFrame, cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(slice, place, n_best, count_sum) of each document that has tokens."""
    many = salts(encoded)
    key = F.col("stripe") * many
    own = encoded.where("kind = 1").select((key + F.pmod("slice", F.lit(many)).cast("int")).alias("key"), "kind", "slice", "docs", "cells", "counts")
    blocks = cells.select(F.explode(F.sequence(key, key + (many - 1))).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("slice"), F.lit(None).cast("binary").alias("docs"), "cells", "counts")
    met = own.unionByName(blocks).repartition(STRIPES * many, "key").sortWithinPartitions("key", "kind").mapInArrow(_score(*shape), SCORES)
    return met.repartition("slice").sortWithinPartitions("slice").mapInArrow(_totals, TOTALS)


def shape_of(files: Files) -> tuple[int, int]:
    """Rows and columns of a stripe's block."""
    own = tokenizers(files)
    return -(-len(own.a) // STRIPES), len(own.b)


def pair_counts(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(a, b, n_docs, best): the documents that hold each linked pair of ids, and whether no other partner of ``a`` has more."""
    files = files or public_files()
    shape = shape_of(files)
    width = shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "cells", "counts")), strict=True):
                row, b = np.divmod(_u4(cells).astype(np.int64), width)
                yield pa.RecordBatch.from_arrays([pa.array(row * STRIPES + stripe), pa.array(b), pa.array(np.frombuffer(counts, "<i8"))], ["a", "b", "n_docs"])

    cells = matrices(stored(encode(docs, files), "align-encoded"), shape)
    pairs = cells.mapInArrow(run, "a bigint, b bigint, n_docs bigint")
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds a space itself; strings of
    special tokens are plain text. Groups end where tokens of both sides end; links are
    overlapping pairs of tokens, and a link counts as many documents as hold its ids linked.

    Null and empty texts, and those whose tokens don't give back the very bytes on a side,
    have zeros and an empty digest. Rows with a null or repeated doc_id are documents of
    their own. Ties for an A id's best partner all count. Texts are encoded whole: a long
    one is a slice of its own. Other columns aren't read, so none can clash. An empty table
    gives no rows.
    """
    files = files or public_files()
    shape = shape_of(files)
    encoded = stored(encode(docs, files), "align-encoded")
    totals = scores(encoded, matrices(encoded, shape), shape)
    own = encoded.where("kind = 0").select("slice", *DOC_NAMES)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return own.join(totals, ["slice", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
