"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on doc_id.

Files hold ascending ranges of doc_id, rows in ascending order. A read is parallel by
stripe; a filter on doc_id skips files, stripes and row groups by their statistics and
Bloom filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlake.llm.arrow import slices
from motorlake.llm.common import shared_path, stored, text_hash
from motorlake.llm.vocabulary import encoder

SCHEMA = "doc_id bigint, part int, place bigint, ids array<int>"
OPTIONS = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(32 << 20)}


def encode(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, part, place, ids): the ids of each whole text and ``end_id``; null counts as empty. part and place number the partitions and their rows."""

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = encoder(tokenizer).encode(piece.column("text"), end_id)
                n = piece.num_rows
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), lists], ["doc_id", "part", "place", "ids"])
                place += n

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Deal the texts out by ranges of doc_id, sort, encode and write a file for each range. Null ids come first.

    Rows with the same doc_id are dealt out and ordered by a hash of the text, so that
    many of them don't come to one task.
    """
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), "text")
    encode(keyed.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key"), tokenizer, end_id).write.options(**OPTIONS).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, part, place, ids); with ``doc_ids`` only these, found through the files' metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids_crc32) of rows of read_token_orc()."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            own = [batch.column(c) for c in ("doc_id", "part", "place")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, part int, place bigint, n_tokens bigint, ids_crc32 bigint")


def with_starts(digests: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before in the files: sums of whole files, then a running sum in each file."""
    digests = stored(digests, "token-digests")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = digests.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "part").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_orc(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files, read them back, and describe each document: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only. Null doc_ids come before all others;
    repeated doc_ids are all kept, in the order of their places in the files. Only doc_id
    and text are read, so other columns can't clash. Whole texts are encoded, however
    long. An empty table writes no rows and gives none.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-orc")
    write_token_orc(docs, path, tokenizer, end_id)
    return with_starts(token_digests(read_token_orc(spark, path)))
