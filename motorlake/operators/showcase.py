"""The showcase: listings with their estimates and all that is known of them, stored so that pages read few files.

Each field that several sources can fill is a struct of its value and its origin, in the
order listing, version, facts of the designation, canonical model. The stored form is
dealt out by rank into slots and by country; a small manifest of slots says how many
rows each has, so that a page by rank reads the slots it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlake.functions.identity import car_identity
from motorlake.functions.listing import clean_model, clean_version, photo
from motorlake.functions.text import norm_gearbox
from motorlake.operators.search import PAGE, Filters

#: What a listing must have to be shown: an exact match, and a home sample without widening.
SHOWN_MATCH, SHOWN_SAMPLE = "exato", "normal"
WLTP_FROM = 2019
#: What of a listing decides whether it is shown.
DECIDING = ["deleted_at", "match_confidence", "vin", "detail_url", "model_id", "year", "km", "price"]
#: What of an estimate a card shows.
ESTIMATED = ["transport", "isv", "iuc", "legalization", "total_pt", "pt_estimated_price", "pt_sample_size", "pt_confidence", "savings", "savings_pct", "verdict"]
#: The text that a search goes through.
SEARCHED = ["catalog_make", "catalog_model", "version_name", "make_raw", "model_raw", "variant"]
#: Rows of a slot, about.
SLOT_ROWS = 1 << 16


def layered(**sources: Column) -> Column:
    """The first known of ``sources``, with the name of the source; null where none is known."""
    return F.coalesce(*[F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(name).alias("origin"))) for name, value in sources.items()])


def joined(listings: DataFrame, estimates: DataFrame, models: DataFrame, versions: DataFrame, catalog_models: DataFrame, sources: DataFrame) -> DataFrame:
    """Listings with structs e, vm, usv and usm and the name of their source.

    Estimate and canonical model must be there; version, catalog model and source may
    miss. The catalog model is that of the version, else the one of the facts.
    """
    return beside(listings.join(_side(estimates, "id", "e", "id"), "id"), models, versions, catalog_models, sources)


def _side(df: DataFrame, key: str, name: str, on: str) -> DataFrame:
    return df.select(F.col(key).alias(on), F.struct(*df.columns).alias(name))


def beside(estimated: DataFrame, models: DataFrame, versions: DataFrame, catalog_models: DataFrame, sources: DataFrame) -> DataFrame:
    """joined() for listings that have their estimate (e) already."""
    side = _side
    out = estimated.join(side(models, "model_id", "vm", "model_id"), "model_id")
    out = out.join(side(versions, "version_id", "usv", "version_id"), "version_id", "left")
    out = out.withColumn("mid", F.coalesce("usv.mid", "facts.mid")).join(side(catalog_models, "mid", "usm", "mid"), "mid", "left")
    return out.join(sources.select("source_id", "source_name"), "source_id", "left")


def mapped(rows: DataFrame) -> DataFrame:
    """Cards of joined(): what a page shows of a listing."""
    c = F.col
    ver = F.when(c("match_confidence") == "exato", c("usv"))
    facts = F.when(c("match_confidence") == "designacao", c("facts"))
    wltp = F.coalesce(c("year"), F.year(F.current_date())) >= WLTP_FROM
    co2 = lambda s: F.when(wltp, s["co2_wltp"]).otherwise(s["co2_nedc"])
    fields = {
        "displacement": layered(listing=c("cc"), version=ver["cc"], facts=facts["cc"], model=c("vm.cc")),
        "co2": layered(listing=c("co2"), version=co2(ver), facts=co2(facts), model=c("vm.co2")),
        "power": layered(listing=c("power_hp"), version=ver["power"], facts=facts["power"], model=c("vm.power_hp")),
        "fuel": layered(listing=c("fuel"), model=c("vm.fuel")),
    }
    by_facts = F.concat_ws(" ", F.concat_ws(" ", c("usm.make"), clean_model(c("usm.model"))), F.concat(facts["power"].cast("string"), F.lit(" cv")))
    raw = F.nullif(F.concat_ws(" ", c("make_raw"), F.coalesce("variant", "model_raw")), F.lit(""))
    named = c("usm").isNotNull()
    title = layered(
        version=F.when(named & ver.isNotNull(), F.concat_ws(" ", c("usm.make"), clean_version(ver["name"]))), facts=F.when(named & facts.isNotNull(), by_facts), listing=raw, none=F.lit("Anúncio"),
    )
    image = F.coalesce(F.when(ver.isNotNull(), F.coalesce(ver["image_url"], F.get(c("usm.image_urls"), F.lit(0)))), F.when(ver.isNull() & facts.isNotNull(), F.get(c("usm.image_urls"), F.lit(0))))
    return rows.select(
        "id", "model_id", "country", "match_confidence", "detail_url", "vin", "deleted_at",
        F.coalesce("make_raw", "vm.make").alias("make"), F.coalesce("model_raw", "vm.model").alias("model"), "variant", title.alias("title"), *(v.alias(k) for k, v in fields.items()), norm_gearbox(c("gearbox")).alias("gearbox"),
        "year", "km", "price", F.coalesce("source_name", "source_site").alias("source"), photo(c("image_url")).alias("photo"), image.alias("catalog_image"), F.when(c("vin").isNotNull(), "disponivel").otherwise("por_verificar").alias("km_trust"),
        "last_seen_at", *(c(f"e.{x}").alias(x) for x in ESTIMATED),
        c("usm.make").alias("catalog_make"), c("usm.model").alias("catalog_model"), c("usv.name").alias("version_name"), "make_raw", "model_raw",
    )


def shown_listings(rows: DataFrame) -> DataFrame:
    """Those alive and exactly matched."""
    return rows.where(F.col("deleted_at").isNull() & (F.col("match_confidence") == SHOWN_MATCH))


def representatives(cards: DataFrame) -> DataFrame:
    """The cards that are shown: alive, exactly matched and soundly sampled, one for each vehicle: the one that saves most, of equals the smallest id.

    Of a card it needs id, DECIDING, pt_confidence and savings.
    """
    shown = shown_listings(cards).where(F.col("pt_confidence") == SHOWN_SAMPLE)
    identity = car_identity(F.col("vin"), F.col("detail_url"), F.col("model_id"), F.col("year"), F.col("km"), F.col("price"))
    best = Window.partitionBy("_identity").orderBy(F.col("savings").desc(), "id")
    return shown.withColumn("_identity", identity).withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_identity", "_place")


@dataclass(frozen=True)
class Showcase:
    """A stored showcase: all rows, and (slot, n) in order of rank."""

    rows: DataFrame
    slots: list[tuple[int, int]]

    def first(self, n: int) -> DataFrame:
        """The slots that hold the ``n`` best ranked rows."""
        needed, held = [], 0
        for slot, size in self.slots:
            if held >= n:
                break
            needed.append(slot)
            held += size
        return self.rows.where(F.col("slot").isin(needed)) if needed else self.rows.limit(0)


def store(cards: DataFrame, path: str, slot_rows: int = SLOT_ROWS) -> None:
    """Write cards by rank: ranges of (savings_pct, id) are the slots, folders within them the countries."""
    slots = max(1, -(-cards.count() // slot_rows))
    ranked = cards.repartitionByRange(slots, F.col("savings_pct").desc_nulls_first(), "id").withColumn("slot", F.spark_partition_id())
    ranked.sortWithinPartitions("country", F.col("savings_pct").desc_nulls_first(), "id").write.option("compression", "zstd").partitionBy("slot", "country").parquet(path)


def open_showcase(spark: SparkSession, path: str) -> Showcase:
    """Read a stored showcase; its slots are counted once."""
    rows = spark.read.parquet(path)
    return Showcase(rows, [(r["slot"], r["n"]) for r in rows.groupBy("slot").agg(F.count("*").alias("n")).orderBy("slot").collect()])


def conditions(filters: Filters) -> Column:
    """The filters over a showcase's own columns."""
    return filters.conditions(SEARCHED, {"total_home": "total_pt", "fuel": "fuel.value"})


def page(shown: Showcase, filters: Filters) -> DataFrame:
    """The rows of one page, in order.

    By rank and without filters, a page lies in the first slots as far as their counts
    reach; other pages read the folders of their countries in all slots, and only the
    columns and row groups that their filters leave.
    """
    plain = filters == Filters(sort="savingsPct", page=filters.page)
    rows = shown.first(filters.page * PAGE) if plain else shown.rows
    keys = {"savingsPct": F.col("savings_pct").desc_nulls_first(), "savings": F.col("savings").desc_nulls_first(), "price": F.col("total_pt").asc_nulls_last(), "recent": F.col("last_seen_at").desc_nulls_first()}
    return rows.where(conditions(filters)).orderBy(keys[filters.sort], F.col("id").asc()).offset((filters.page - 1) * PAGE).limit(PAGE)


def total(shown: Showcase, filters: Filters) -> DataFrame:
    return shown.rows.where(conditions(filters)).agg(F.count("*").alias("total"))
