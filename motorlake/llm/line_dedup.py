"""Line dedup: frequent long lines stay in one document only.

Native: DataFrame functions only. The hashes of candidate lines are dealt out by
range, sorted by (hash, document descending, position) and read as a stream: the
first document of each run is the one that keeps the line. What comes back is one
sparse bitmap for each document that loses lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlake.llm.common import WHITE, ascii_lower, fresh, let, stored, text_hash

MIN_CHARS = 40
MIN_DOCS = 5
#: At most so many hashes are dealt out over several ranges each; any other one has less than this part of all lines.
HOT_KEYS = 1024
#: A hash is dealt out further from this share of all lines on, and always from so many lines on, which a task sorts in memory.
HOT_SHARE = 0.001
HOT_LINES = 1 << 20


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def candidate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2): a row for each line whose key is long enough; 128 bits of hash."""
    lines = docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long = lines.select("doc_id", "text_key", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = long.select("doc_id", "text_key", "pos", ascii_lower(F.col("line")).alias("key"))
    return keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def hot_hashes(candidates: DataFrame) -> list[int]:
    """Hashes of the most frequent lines, HOT_KEYS at most. A hint for the dealing out only: the result doesn't depend on it."""
    top = candidates.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {HOT_KEYS}, {HOT_KEYS * 20})").alias("top")).first()
    return [x["item"] for x in top["top"] or [] if x["count"] > max(MIN_DOCS, min(HOT_LINES, HOT_SHARE * top["n"]))]


def dropped_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, dropped) for documents that lose lines.

    ``dropped`` is a sparse bitmap: array<struct<word: int, bits: bigint>> ordered by
    word; bit i of word w stands for line 64 w + i. Lines without a bit are kept.
    """
    spark = docs.sparkSession
    candidates = stored(candidate_lines(docs, min_chars), "line-hashes")  # the texts are read and cut once
    hot = hot_hashes(candidates)
    ways = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    deal = F.when(F.col("h1").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(ways)).cast("int")) if hot else F.lit(None).cast("int")
    dealt = candidates.withColumn("part", F.coalesce(deal, F.lit(-1)))
    order = [F.col("doc_id").desc(), F.col("pos").asc()]
    ranged = dealt.repartitionByRange("h1", "h2", "part").sortWithinPartitions("h1", "h2", "part", *order)
    run = Window.partitionBy("h1", "h2", "part").orderBy(*order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = (F.row_number().over(run) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(run))
    runs = ranged.withColumn("first_of_doc", starts.cast("int")).select("*", F.sum("first_of_doc").over(whole).alias("run_docs"), F.first("doc_id").over(whole).alias("run_keeper"), (F.row_number().over(run) == 1).alias("heads"))
    decided = runs.select("doc_id", "text_key", "pos", "h1", "h2", "part", "run_docs", "run_keeper", "heads")
    cold = decided.where("part = -1").select("doc_id", "text_key", "pos", F.col("run_docs").alias("n_docs"), F.col("run_keeper").alias("keeper"))
    if hot:  # the runs of a hot hash are stitched: as many rows as hot hashes
        whole_runs = decided.where("part >= 0 and heads").groupBy("h1", "h2").agg(F.sum("run_docs").alias("n_docs"), F.max("run_keeper").alias("keeper"))
        warm = decided.where("part >= 0").join(F.broadcast(whole_runs), ["h1", "h2"]).select("doc_id", "text_key", "pos", "n_docs", "keeper")
        cold = cold.unionByName(warm)
    lost = cold.where((F.col("n_docs") >= min_docs) & F.coalesce(F.col("doc_id") < F.col("keeper"), F.col("keeper").isNotNull()))
    word = lost.groupBy("doc_id", "text_key", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return word.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def keep_lines(lines: Column, dropped: Column) -> Column:
    """The lines without a bit in the sparse bitmap; one step for each line."""

    def dense(sparse: Column) -> Column:
        by_word = F.map_from_entries(sparse)
        last = F.element_at(sparse, -1)["word"]
        return let(by_word, lambda m: F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("bigint"))))

    def bit(bits: Column, i: Column) -> Column:
        return F.coalesce(F.call_function("getbit", F.get(bits, F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64))).cast("int"), F.lit(0))

    return let(F.struct(lines.alias("l"), dense(dropped).alias("b")), lambda s: F.filter(s["l"], lambda _, i: bit(s["b"], i) == 0))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` after line dedup and columns n_lines, n_dropped (long).

    A text is split at \\n; null or empty is one empty line. A line's key is the line
    without ASCII white space at its ends, A-Z lower-cased. Keys of ``min_chars`` code
    points or more found in ``min_docs`` documents or more lose all their lines except
    in the largest doc_id that holds them. A null text comes back as an empty one.

    Repeated rows: the same doc_id counts as one document, so all its rows keep a line
    that the doc_id keeps; each row's bitmap is its own. Null doc_ids are one document,
    smaller than all others. Other columns pass through, whatever their names; columns
    named n_lines or n_dropped are replaced, or pass through too without ``counts``.
    Empty tables give empty results.
    """
    row_key, mark_id, mark_key, mark = (fresh(docs, c) for c in ("row_key", "mark_id", "mark_key", "mark_dropped"))
    bitmaps = dropped_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias(mark_id), F.col("text_key").alias(mark_key), F.col("dropped").alias(mark))
    left = docs.withColumn(row_key, text_hash(F.col("text")))
    joined = left.join(bitmaps.hint("shuffle_hash"), F.col(row_key).eqNullSafe(F.col(mark_key)) & F.col("doc_id").eqNullSafe(F.col(mark_id)), "left")
    n_lost = F.aggregate(F.coalesce(F.col(mark), F.array().cast("array<struct<word:int,bits:bigint>>")), F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x["bits"]))
    kept = F.when(F.col(mark).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(keep_lines(lines_of(F.col("text")), F.col(mark)), "\n"))
    more = {"n_lines": F.size(lines_of(F.col("text"))).cast("bigint"), "n_dropped": n_lost} if counts else {}
    return joined.withColumns(more | {"text": kept}).drop(row_key, mark_id, mark_key, mark)
