"""The operators as stages of a corpus pipeline: each takes and returns the rows of ``documents``.

Every stage decides on a row by its own text; rows without doc_id, and rows that share
one, are rows like any other. Columns that aren't named here pass through, whatever their
names, types and nulls. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from motorlake.llm import decontaminate, language, pieces, simhash
from motorlake.llm.common import fresh, shared_path, stored, table, text_hash
from motorlake.llm.line_dedup import line_dedup
from motorlake.session import ship

#: Benchmark items of fewer words don't identify a text, so no document goes for them.
LEAK_WORDS = 5
#: Rows of (doc_id, text_key) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language can't be told, null texts and texts without a letter; where ``lang`` is null, it becomes the language found.

    Where no row has a lang, nothing is learned, and only rows without a letter go.
    """
    ship(spark)
    profiles = language.fit_profiles(docs.where(~language.held_out()))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    kept = F.col(pred) != language.UNDETERMINED
    if not profiles.langs:
        kept = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = language.identify(docs, profiles, names=(pred, score)).where(kept)
    lang = F.coalesce("lang", F.when(F.col(pred) != language.UNDETERMINED, F.col(pred)))
    return found.withColumn("lang", lang).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; n_chars follows. Documents that lose all lines stay, with an empty text."""
    out = line_dedup(docs, counts=False).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text_key) isn't in ``rows``; null ids match. The texts are only shuffled where ``rows`` is too large to broadcast."""
    gone_id, gone_key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = rows.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), (text_hash(docs["text"]) == F.col(gone_key)) & docs["doc_id"].eqNullSafe(F.col(gone_id)), "left_anti")


def _orderable(kind) -> bool:
    return not isinstance(kind, MapType | VariantType) and all(_orderable(x) for x in ([kind.elementType] if hasattr(kind, "elementType") else [f.dataType for f in getattr(kind, "fields", [])]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash group: of its smallest doc_id, null only where all are null; of several texts of that doc_id, the one with the least hash.

    Of rows with the same doc_id and text, the one that is least in its columns stays, or
    any one of them where a column's type has no order.
    """
    ship(spark)
    groups = simhash.simhash_groups(docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), "text"), also=("text_key",))
    groups = stored(groups.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("rows")), "near-groups")
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("best")).select("best.doc_id", "best.text_key")
    same = F.col("a.text_key").eqNullSafe(F.col("b.text_key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    dropped = stored(groups.alias("a").join(best.alias("b"), same, "left_anti").select("doc_id", "text_key"), "near-dropped")
    out = _without(docs, dropped)
    repeated = groups.where("rows > 1").select("doc_id", "text_key")
    if repeated.isEmpty():
        return out
    once, several = _without(out, repeated), out.join(repeated.select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key")), (text_hash(out["text"]) == F.col("again_key")) & out["doc_id"].eqNullSafe(F.col("again_id")), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    pick = F.min(row) if all(_orderable(f.dataType) for f in docs.schema.fields) else F.any_value(row)
    return once.unionByName(several.groupBy("doc_id", text_hash(F.col("text")).alias(fresh(docs, "text_key"))).agg(pick.alias("row")).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item of LEAK_WORDS words or more."""
    ship(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), min_words=LEAK_WORDS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left: doc_id, ids, n_ids, ids_crc32, round_trip."""
    ship(spark)
    out = pieces.encode_decode(docs, pieces.Pieces(pieces.model_file()))
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "ids_crc32", "round_trip")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", piece_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
