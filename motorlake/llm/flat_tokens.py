"""Token counts of flat, unindexed token files by a scan for end-of-document ids.

A file is little-endian ids of 16 bits, or of 32 where the vocabulary needs them, one
document after the other, each closed by the end id. There is no index: blocks of a file
are read by their byte ranges and searched as arrays, independently of each other; a
prefix scan over a small row for each block stitches documents that cross block
boundaries and numbers them.
"""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlake.llm.arrow import slices
from motorlake.llm.common import shared_path, stored
from motorlake.llm.vocabulary import encoder, vocabulary_size

#: Ids in a block.
BLOCK_IDS = 1 << 18
#: Bytes of blocks that one task should search.
TASK_BYTES = 64 << 20
#: A row of the file of doc_ids: the id in 8 bytes, and one that tells null.
ID_BYTES = 9
CONCURRENT_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 if all ids of the vocabulary and the end id fit, else 4."""
    return 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4


def write_flat_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int) -> None:
    """Flat files in ``path``/kind=ids, in the order of the rows of ``docs``; the texts aren't shuffled.

    A file of the same name in ``path``/kind=docs holds the doc_ids of the documents, in
    the same order. Spark's text writer puts the bytes of a row and a separator, which is
    the end id, into a file. The two files of a task are written side by side in the order
    of its rows, and committed together, so they fit whatever a repeated task gets to read.
    """
    separator = end_id.to_bytes(width, "little")
    kind = f"<u{width}"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder(tokenizer, special=False).encode(part.column("text"))
                flat = ids.astype(kind).tobytes()
                bounds = (width * offsets).tolist()
                docs_of = [(b"\0" * 8 + b"\1") if i is None else i.to_bytes(8, "little", signed=True) + b"\0" for i in part.column("doc_id").to_pylist()]
                values = [x for pair in zip((flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), docs_of, strict=True) for x in pair]
                yield pa.RecordBatch.from_arrays([pa.array(["ids", "docs"] * part.num_rows, pa.string()), pa.array(values, pa.binary())], ["kind", "value"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "kind string, value binary").select("kind", F.col("value").cast("string").alias("value"))
    conf = docs.sparkSession.conf
    known = conf.get(CONCURRENT_WRITERS)
    conf.set(CONCURRENT_WRITERS, "2")  # so that Spark needn't sort the rows by kind
    try:
        rows.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", separator.decode("iso-8859-1")).text(path)
    finally:
        conf.set(CONCURRENT_WRITERS, known)


def blocks_of(spark: SparkSession, path: str, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, first_byte, n_bytes): fixed blocks of all files in a folder, dealt out evenly; the last one of a file is shorter. The contents aren't read."""
    size = width * block_ids
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    cut = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))).alias("block"))
    ways = max(1, min(-(-total // size), max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))
    ranges = cut.select("file", "block", (F.col("block") * size).alias("first_byte"), F.least(F.lit(size).cast("bigint"), F.col("length") - F.col("block") * size).alias("n_bytes"))
    return ranges.repartition(ways)


def read_range(file: str, first: int, n: int) -> bytes:
    """Bytes of a file of a shared folder, given by the path that Spark gives, not escaped: a local file, or a store that pyarrow.fs opens."""
    if file.startswith("file:"):
        with open("/" + file.removeprefix("file:").lstrip("/"), "rb") as f:
            f.seek(first)
            data = f.read(n)
    else:
        store, name = fs.FileSystem.from_uri(quote(file, safe=":/@"))
        with store.open_input_file(name) as f:
            data = f.read_at(n, first)
    if len(data) != n:
        raise EOFError(f"{file} has {len(data)} of {n} bytes at {first}")
    return data


def scan_blocks(blocks: DataFrame, end_id: int, width: int) -> DataFrame:
    """(file, block, n_ids, ends): the places of end ids in each block; a block is in memory at a time."""

    def run(batches):
        for batch in batches:
            for i, (file, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "first_byte", "n_bytes")), strict=True)):
                ids = np.frombuffer(read_range(file, first, n), f"<u{width}")
                ends = pa.array([np.flatnonzero(ids == end_id).astype(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("file").slice(i, 1), batch.column("block").slice(i, 1), pa.array([len(ids)], pa.int64()), ends], ["file", "block", "n_ids", "ends"])

    return blocks.mapInArrow(run, "file string, block bigint, n_ids bigint, ends array<bigint>")


def doc_ids_of(file: str, first: int, n: int, width: int) -> pa.Array:
    """The doc_ids beside documents ``first`` to ``first + n - 1`` of a file of write_flat_tokens()."""
    step = ID_BYTES + width
    data = np.frombuffer(read_range(file.replace("/kind=ids/", "/kind=docs/"), step * first, step * n), np.uint8).reshape(n, step)
    return pa.array(data[:, :8].copy().view("<i8")[:, 0], mask=data[:, 8] == 1)


def _named(blocks: DataFrame, width: int) -> DataFrame:
    """Blocks with the doc_ids of the documents that end in each."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "docs_before")), lengths(batch.column("at")), strict=True)
            named = [doc_ids_of(file, first, n, width) if n else pa.array([], pa.int64()) for file, first, n in rows]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in named]))).astype(np.int32), pa.concat_arrays([pa.array([], pa.int64()), *named]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "doc_ids"])

    return blocks.mapInArrow(run, "file string, carry bigint, docs_before bigint, at array<bigint>, doc_ids array<bigint>")


def lengths(lists: pa.ListArray) -> list[int]:
    return np.diff(lists.offsets.to_numpy()).tolist()


def count_tokens(spark: SparkSession, path: str, end_id: int, width: int, block_ids: int = BLOCK_IDS, named: bool = False) -> DataFrame:
    """(ordinal, start, n_tokens) of each document of a folder of flat files; with ``named``, doc_id too, from the files beside.

    ordinal counts documents from 0 over the files in order of their names; start counts
    ids, end ids included; n_tokens is without the end id. Ids after a file's last end id
    are one more, unfinished document. Empty files and folders give nothing. A file
    whose length isn't a multiple of ``width`` raises an error.
    """
    found = stored(scan_blocks(blocks_of(spark, path, width, block_ids), end_id, width), "flat-blocks")
    last = F.col("block") * block_ids + F.element_at("ends", -1)
    found = found.withColumn("last_end", F.when(F.size("ends") > 0, last))
    files = found.groupBy("file").agg(F.sum("n_ids").alias("ids"), F.sum(F.size("ends")).alias("ended"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last_end"))
    files = files.withColumn("open", (F.col("ids") > F.col("last_end") + 1).cast("bigint"))
    before_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("*", F.coalesce(F.sum("ids").over(before_file), F.lit(0)).alias("id_base"), F.coalesce(F.sum(F.col("ended") + F.col("open")).over(before_file), F.lit(0)).alias("doc_base"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the scan over a file's blocks sees their counts only; the places of ends come back beside them
    counted = found.select("file", "block", F.size("ends").alias("n"), "last_end")
    stitched = counted.select("file", "block", "n", F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"))
    placed = stitched.where("n > 0").drop("n").join(found.select("file", "block", "ends"), ["file", "block"]).select("file", "carry", "docs_before", F.transform("ends", lambda e: e + F.col("block") * block_ids).alias("at"))
    placed = _named(placed, width) if named else placed.withColumn("doc_ids", F.lit(None).cast("array<bigint>"))
    spans = placed.select("file", "docs_before", "doc_ids", F.arrays_zip(F.concat(F.array("carry"), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0)))).alias("from"), F.col("at").alias("to")).alias("spans"))
    each = spans.select("file", "docs_before", "doc_ids", F.posexplode("spans").alias("i", "span"))
    doc_id = F.get("doc_ids", F.col("i")).alias("doc_id")
    ended = each.join(files.select("file", "id_base", "doc_base"), "file").select(doc_id, (F.col("doc_base") + F.col("docs_before") + F.col("i")).alias("ordinal"), (F.col("id_base") + F.col("span.from") + 1).alias("start"), (F.col("span.to") - F.col("span.from") - 1).alias("n_tokens"))
    if named:
        return ended
    opened = files.where("open = 1").select((F.col("doc_base") + F.col("ended")).alias("ordinal"), (F.col("id_base") + F.col("last_end") + 1).alias("start"), (F.col("ids") - F.col("last_end") - 1).alias("n_tokens"))
    return ended.drop("doc_id").unionByName(opened)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat files in the shared folder and count them back: doc_id, ordinal, start, n_tokens.

    The end id is the first one that the vocabulary doesn't have, so no text holds it;
    names of special tokens in a text are ordinary text. ordinal and start are the places
    in the files, which follow the order of the rows of ``docs``. Null and empty texts count
    0 tokens, however long ones all of theirs; repeated rows and null doc_ids count each;
    other columns aren't read, so they can't clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "flat-tokens")
    end_id = vocabulary_size(tokenizer) if end_id is None else end_id
    width = id_width(tokenizer, end_id)
    write_flat_tokens(docs, path, tokenizer, end_id, width)
    if spark.read.format("binaryFile").load(path).where("length > 0").isEmpty():
        return spark.createDataFrame([], "doc_id bigint, ordinal bigint, start bigint, n_tokens bigint")
    return count_tokens(spark, f"{path}/kind=ids", end_id, width, named=True)
