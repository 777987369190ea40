"""Upserts, histories and differential publishing as joins of whole tables.

Nothing is updated in place: each function returns the new table, or the changes to make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlake.functions.semantics import distinct_from


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; map-side combined, so a frequent key doesn't gather in one task."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merged: list[str], seen: str | None = None) -> DataFrame:
    """``old`` after ``new`` (one row a key): columns in ``merged`` take the new value unless null, ``seen`` the greater, the others stay as first inserted. Rows that return come alive again (deleted_at)."""
    known = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns], F.lit(True).alias("_is_new"))
    on = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    joined = old.withColumn("_is_old", F.lit(True)).join(known, on, "full_outer")

    def value(c: str) -> Column:
        mine, theirs = F.col(c), F.col(f"_new_{c}") if c in new.columns else F.lit(None)
        if c == "deleted_at":
            return F.when(F.col("_is_new").isNotNull(), F.lit(None)).otherwise(mine)
        if c == seen:
            return F.greatest(mine, theirs)
        if c in merged:
            return F.coalesce(theirs, mine)
        return F.when(F.col("_is_old").isNotNull(), mine).otherwise(theirs)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def kept_cash_price(old: Column, advertised: Column, new: Column, checked: Column) -> Column:
    """The verified cash price while the advertised one is unchanged, else the new price."""
    same = new.isNull() | (new == F.coalesce(advertised, old))
    return F.when(F.coalesce(checked, F.lit(False)) & same, old).otherwise(F.coalesce(new, old))


def price_changes(seen: DataFrame, key: str, price: str, order: list[str]) -> DataFrame:
    """Observations whose price differs from the one before, the first one included."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(*order))
    return seen.withColumn("_before", before).where(distinct_from(F.col(price), F.col("_before"))).drop("_before")


def stale(rows: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Rows not seen for so many days are marked as deleted; others keep what they have."""
    return rows.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & (F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days))), as_of).otherwise(F.col("deleted_at")))


def changes(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): insert, update or keep for what the source has; stray for what only the target has."""
    rest = [c for c in source.columns if c not in keys]
    mine = source.select(*keys, F.struct(*rest).alias("_source"))
    theirs = target.select(*keys, F.struct(*rest).alias("_target"))
    action = F.when(F.col("_target").isNull(), "insert").when(F.col("_source").isNull(), "stray").when(distinct_from(F.col("_source"), F.col("_target")), "update").otherwise("keep")
    return mine.join(theirs, keys, "full_outer").select(*keys, action.alias("action"))


def stray_actions(strays: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """What to do with published rows that left the showcase: soft-delete the dead, demote the living, and leave alone what the corpus doesn't know: absence is no proof of death."""
    known = corpus.select(*keys, F.coalesce(F.col("alive"), F.lit(False)).alias("_alive"))
    action = F.when(F.col("_alive").isNull(), "untouched").when(F.col("_alive"), "demote").otherwise("soft_delete")
    return strays.join(known, keys, "left").select(*keys, action.alias("action"))


def remap(children: DataFrame, source_ids: DataFrame, target_ids: DataFrame, reference: str, natural: list[str]) -> DataFrame:
    """Children with the target's surrogate ids: source id to natural key to target id. Children of unknown parents are left out."""
    bridge = source_ids.select(F.col("id").alias("_from"), *natural).join(target_ids.select(F.col("id").alias("_to"), *natural), natural).select("_from", "_to")
    return children.join(bridge, children[reference] == F.col("_from")).withColumn(reference, F.col("_to")).drop("_from", "_to")


def clusters(rows: DataFrame, group: str, start: str, gap: int = 2) -> DataFrame:
    """Chains of starts less than ``gap`` apart become one generation, open at the end or ending before the next one; the first has a year of grace."""
    by = Window.partitionBy(group).orderBy(start)
    fresh = F.when(F.coalesce(F.col(start) - F.lag(start).over(by) >= gap, F.lit(True)), 1).otherwise(0)
    numbered = rows.select(group, start).distinct().withColumn("_new", fresh).withColumn("generation", (F.sum("_new").over(by) - 1).cast("int"))
    found = numbered.groupBy(group, "generation").agg(F.min(start).alias("first_start"), F.count("*").alias("starts"))
    after = Window.partitionBy(group).orderBy("generation")
    return found.select(group, "generation", "starts", F.when(F.col("generation") == 0, F.col("first_start") - 1).otherwise(F.col("first_start")).alias("year_start"), (F.lead("first_start").over(after) - 1).alias("year_end"))


def kept_fields(old: Column, new: Column, fields: list[str], kept: list[str], keep: Column) -> Column:
    """The struct ``new`` with the fields ``kept`` of ``old`` where ``keep`` holds and they are known; a missing ``old`` keeps nothing."""
    held = F.coalesce(keep, F.lit(False))
    return F.struct(*[(F.when(held, F.coalesce(old[f], new[f])).otherwise(new[f]) if f in kept else new[f]).alias(f) for f in fields])


def snapshot(report: DataFrame, by: list[str]) -> DataFrame:
    """(line): each row of a report as JSON with its columns in alphabetical order, sorted by ``by`` and then by the line: the same rows always give the same bytes."""
    line = F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"})
    return report.select(*by, line.alias("line")).orderBy(*by, "line").select("line")


def tab_separated(report: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as tab-separated text, unknown values empty, tabs and line ends inside values as spaces."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in columns]
    return report.select(F.concat_ws("\t", *cells).alias("line"))


def outbox(matches: DataFrame, sent: DataFrame, base: str) -> DataFrame:
    """The mails of matches that none was sent for: match_id, recipient, title, subject, address.

    matches: match_id, email, alert, make, model, year, listing_id. Whoever sends them adds
    their match_id to ``sent`` afterwards, so a mail that fails stays in the outbox and
    holds up neither others nor the match itself.
    """
    title = F.coalesce(F.nullif(F.concat_ws(" ", F.nullif("make", F.lit("")), F.nullif("model", F.lit("")), F.col("year").cast("string")), F.lit("")), F.lit("Anúncio"))
    due = matches.join(sent.select("match_id").distinct(), "match_id", "left_anti").withColumn("title", title)
    subject = F.concat(F.lit("Apareceu um "), F.col("title"), F.lit(" que encaixa no teu alerta"))
    return due.select("match_id", F.col("email").alias("recipient"), "alert", "title", subject.alias("subject"), F.concat(F.lit(f"{base}/anuncio/"), F.col("listing_id").cast("string")).alias("address"))
