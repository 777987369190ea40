"""Which listings get an estimate, which have to be computed again, and with which data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlake.functions import tax
from motorlake.functions.text import excluded_territory
from motorlake.operators import market

#: From this many kilometres and months on a car is used in tax law.
NEW_KM, NEW_MONTHS = 6000, 6
FOREIGN = ("DE", "FR", "BE", "NL", "ES")
#: The first year of the present norm for emissions.
WLTP_FROM = 2019


def eligible(now: Column, foreign: tuple[str, ...] = FOREIGN) -> Column:
    """Whether a listing can have an estimate; never null.

    Columns: country, deleted_at, model_id, is_damaged, detail_url, price, year, km, fuel,
    first_registration, postal_code, region. An unknown registration, region or damage
    doesn't speak against a listing; an unknown price, year, km or fuel does.
    """
    c = F.col
    holds = (
        c("country").isin(*foreign)
        & c("deleted_at").isNull()
        & c("model_id").isNotNull()
        & ~F.coalesce(c("is_damaged"), F.lit(False))
        & ~c("detail_url").contains("/leilao/")
        & (c("price") > 0)
        & c("year").isNotNull()
        & (c("km") > NEW_KM)
        & c("fuel").isNotNull()
        & F.coalesce(c("first_registration") <= F.add_months(now, -NEW_MONTHS), F.lit(True))
        & ~excluded_territory(c("country"), c("region"), c("postal_code"))
    )
    return F.coalesce(holds, F.lit(False))


def effective_tier() -> Column:
    """The tier that an estimate can rest on: exact with a version, by designation with facts."""
    tier = F.col("match_confidence")
    return F.when((tier == "exato") & F.col("version_id").isNotNull(), "exato").when((tier == "designacao") & F.col("facts").isNotNull(), "designacao")


def stale(estimate: str = "estimate") -> Column:
    """Whether an estimate is missing, older than the listing, or rests on another tier or derivative. ``estimate`` is a struct (computed_at, match_kind, derivative) or null."""
    e, tier = F.col(estimate), effective_tier()
    other_facts = (F.col("match_confidence") == "designacao") & ~F.col("facts.derivative").eqNullSafe(e["derivative"])
    unmarked = (F.col("match_confidence") == "exato") & F.col("version_id").isNotNull() & e["derivative"].isNull()
    return F.coalesce(e.isNull() | (F.col("updated_at") > e["computed_at"]) | ~tier.eqNullSafe(e["match_kind"]) | other_facts | unmarked, F.lit(False))


def registered(rows: DataFrame) -> DataFrame:
    """``rows`` with registered_on, the first of July of the listing's year where no registration is known, and registered_assumed."""
    assumed = F.make_date(F.col("year").cast("int"), F.lit(7), F.lit(1))
    return rows.withColumns({"registered_on": F.coalesce(F.col("first_registration").cast("date"), assumed), "registered_assumed": F.col("first_registration").isNull()})


def effective_specs(rows: DataFrame) -> DataFrame:
    """``rows`` with match_kind, cc_used, co2_used, power_used, derivative_used, gen_start, gen_end, from_catalog and registered().

    The listing's own data come first; the version (a struct with cc, co2_wltp, co2_nedc,
    power, derivative, gen_start, gen_end) or the facts of the designation (the same
    fields) fill what is missing, emissions only by the norm of the year of registration.
    from_catalog names what was filled. An ambiguous generation has no window.
    """
    kind = effective_tier()
    wltp = F.year("registered_on") >= WLTP_FROM
    source = F.when(kind == "exato", F.col("version")).when(kind == "designacao", F.col("facts"))
    held = registered(rows).withColumn("source_used", source)
    s = F.col("source_used")
    fills = {"cc": s["cc"], "co2": F.when(wltp, s["co2_wltp"]).otherwise(s["co2_nedc"]), "power": s["power"]}
    own = {"cc": F.col("cc"), "co2": F.col("co2"), "power": F.col("power_hp")}
    named = F.array_compact(F.array(*[F.when(own[k].isNull() & fills[k].isNotNull(), F.lit(k)) for k in fills]))
    window = (kind == "designacao") | ~F.coalesce(F.col("gen_ambiguous"), F.lit(False))
    return held.withColumns(
        {f"{k}_used": F.coalesce(own[k], fills[k]) for k in fills}
        | {"match_kind": kind, "derivative_used": s["derivative"], "gen_start": F.when(window, s["gen_start"]), "gen_end": F.when(window, s["gen_end"]), "from_catalog": named}
    ).drop("source_used")


def has_specs() -> Column:
    """Whether the data suffice: power always, displacement and emissions unless electric."""
    return F.col("power_used").isNotNull() & ((F.col("fuel") == "elétrico") | F.col("cc_used").isNotNull() & F.col("co2_used").isNotNull())


#: What an estimate row has besides its audit.
ESTIMATE = ["id", "origin_price", "transport", "isv", "iuc", "legalization", "total_pt", "pt_estimated_price", "pt_sample_size", "pt_confidence", "savings", "savings_pct", "verdict", "isv_table_year"]


def sample_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (listings with family, and the columns of effective_specs()) as market.home_prices() takes them: with km_band, and the power and derivative that hold."""
    specified = effective_specs(rows).withColumn("km_band", market.km_band(F.col("km")))
    return specified.drop("power_hp").withColumnsRenamed({"power_used": "power_hp", "derivative_used": "derivative"})


def estimate(rows: DataFrame, now: Column, at: Column, days: int = market.WINDOW_DAYS, tables: tax.TaxTables = tax.TABLES_2026, only: DataFrame | None = None) -> DataFrame:
    """Estimate rows (ESTIMATE, inputs, computed_at) of the eligible ones of ``rows``, all listings of all markets; ``only`` names (id) those asked for.

    Home prices come from the ``days`` before ``now``; taxes hold on the day ``at``, by the
    year and exact age of the registration. Listings without data or a home sample, and
    those far below their own market, get no row: see due() for what is to be computed.
    ``inputs`` is the audit as JSON: the data used, where they came from, the tier, and
    the sample of the listing's own market. ``rows`` is read several times, so it had better
    be a stored table.
    """
    held = sample_rows(rows)
    power_known = F.col("power_hp").isNotNull() & ((F.col("fuel") == "elétrico") | F.col("cc_used").isNotNull() & F.col("co2_used").isNotNull())
    seen = market.observations(held.where(F.col("observed_at") <= now), since=F.timestamp_add("DAY", F.lit(-days), now), also=("family", "derivative"))
    asked = held.where(eligible(now) & power_known)
    if only is not None:
        asked = asked.join(only, "id", "left_semi")
    priced = market.home_prices(asked, seen).where("home_price is not null")
    told = ["id", "model_id", "country", "year", "km", "power_hp", "price", "fuel", "cc_used", "co2_used", "registered_on", "registered_assumed", "match_kind", "derivative", "version_id", "from_catalog", "gen_start", "gen_end", "home_price", "sample_size", "confidence"]
    sampled = market.origin_samples(priced.select(*told), rows.where("deleted_at is null"))
    sound = sampled.where(market.plausible(sampled))
    year = F.year("registered_on")
    age = tax.age_years(F.col("registered_on"), at)
    parts = tax.registration_tax(F.col("fuel"), F.col("cc_used"), F.col("co2_used"), year, age, tables)
    annual = tax.annual_tax(F.col("fuel"), F.col("cc_used"), F.col("co2_used"), year, tables)
    taxed = sound.withColumns(parts | {"iuc": annual})
    total = taxed.withColumn("total_pt", tax.landed_cost(F.col("price"), F.col("country"), F.col("isv"), F.col("iuc"))).withColumn("savings", F.col("home_price") - F.col("total_pt"))
    judged = total.withColumn("savings_pct", tax.savings_pct(F.col("savings"), F.col("home_price"))).withColumn("verdict", tax.verdict(F.col("savings_pct")))
    enough = F.col("origin_n") >= market.GUARDS.origin_least
    exact, known = F.col("match_kind") == "exato", F.col("match_kind").isNotNull()
    audit = F.struct(
        F.col("cc_used").alias("cc"), F.col("co2_used").alias("co2"), "fuel", F.date_format("registered_on", "yyyy-MM-dd").alias("firstRegistration"), F.col("registered_assumed").alias("firstRegistrationAssumed"),
        F.col("match_kind").alias("matchKind"), "derivative", F.when(enough, F.col("origin_median")).alias("originMedian"), F.when(enough, F.col("origin_n")).alias("originSampleSize"), F.when(exact, F.col("version_id")).alias("versionId"),
        F.when(known, F.col("from_catalog")).alias("fromCatalog"), F.when(known, F.struct("gen_start", "gen_end")).alias("genWindow"),
        F.struct("isv_displacement", "isv_co2", "isv_surcharge", "isv_rate_pct", "isv_reduction_pct", "assumptions").alias("isv"),
    )
    return judged.select(
        "id", F.col("price").alias("origin_price"), tax.transport(F.col("country")).alias("transport"), tax.half_up(F.col("isv")).cast("int").alias("isv"), tax.half_up(F.col("iuc")).cast("int").alias("iuc"), F.lit(tax.LEGALISATION).alias("legalization"),
        "total_pt", F.col("home_price").alias("pt_estimated_price"), F.col("sample_size").alias("pt_sample_size"), F.col("confidence").alias("pt_confidence"), "savings", "savings_pct", "verdict", F.lit(tables.year).alias("isv_table_year"),
        F.to_json(audit).alias("inputs"), now.alias("computed_at"),
    )


def due(rows: DataFrame, estimates: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id) of the listings to compute again: whose estimate is stale(), or whose home sample can have changed by the observations ``fresh`` (model_id, year, km_band).

    A sample spans three years and five bands, so each observation is dealt out over the
    cells (model, year, band) whose samples it can be in, and listings meet these on equal
    cells.
    """
    kept = estimates.select("id", F.struct("computed_at", F.get_json_object("inputs", "$.matchKind").alias("match_kind"), F.get_json_object("inputs", "$.derivative").alias("derivative")).alias("estimate"))
    behind = rows.join(kept, "id", "left").where(stale()).select("id")
    around = lambda c, n: F.explode(F.sequence(F.col(c) - n, F.col(c) + n)).alias(c)
    cells = fresh.select("model_id", around("year", 1), "km_band").select("model_id", "year", around("km_band", 2)).distinct()
    touched = rows.withColumn("km_band", market.km_band(F.col("km"))).join(cells, ["model_id", "year", "km_band"], "left_semi").select("id")
    return behind.unionByName(touched).distinct()


def merged(old: DataFrame, computed: DataFrame, asked: DataFrame) -> DataFrame:
    """The estimates after a run: of the listings asked for what was computed, or nothing; all others as they were."""
    return old.join(asked.select("id"), "id", "left_anti").unionByName(computed.join(asked.select("id"), "id", "left_semi"))
