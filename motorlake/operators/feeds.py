"""Feeds as folders of NDJSON: append-only logs by source, and rules joined to titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.sources import ndjson


#: Lines of a file, at most.
FILE_LINES = 1_000_000


def append_lines(lines: DataFrame, path: str) -> None:
    """Append (line, source) to the logs in ``path``, a folder for each source; earlier files stay as they are.

    Files are compressed. As one can only be read from its start, none has more than
    FILE_LINES lines.
    """
    lines.write.mode("append").partitionBy("source").option("maxRecordsPerFile", FILE_LINES).text(path, compression="gzip")


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """All records of the logs in ``path`` with _source, the folder's name without -events, and _bad, the lines that aren't JSON."""
    rows = spark.read.schema(ndjson.SCHEMA).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/source=([^/]*)/", 1))
    return rows.withColumn("_source", ndjson.source_name(folder))


def line_counts(rows: DataFrame) -> DataFrame:
    """(source, lines, bad) of read_folders(): how many lines each source has, and how many of them aren't JSON."""
    return rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("lines"), F.count_if(F.col("_bad").isNotNull() & F.col("id").isNull()).alias("bad"))


def longest_prefix(rows: DataFrame, rules: DataFrame, text: str, prefix: str, key: str) -> DataFrame:
    """``rows`` with the longest ``prefix`` of ``rules`` that ``text`` equals or goes on from behind a space or hyphen; null where none does.

    Both sides meet on the first word, so no row is compared with all rules.
    """
    first = lambda c: F.lower(F.regexp_extract(c, r"^[^ -]*", 0))
    short, low = F.lower(F.col(prefix)), F.lower(F.col(text))
    met = rows.withColumn("_first", first(F.col(text))).join(rules.select(prefix, first(F.col(prefix)).alias("_first")), "_first")
    starts = met.where((low == short) | low.startswith(F.concat(short, F.lit(" "))) | low.startswith(F.concat(short, F.lit("-"))))
    best = starts.groupBy(key).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, key, "left")
