"""What the version resolver reads of a raw listing: family, hard signals, and words that tell twins apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlake.functions.semantics import let
from motorlake.functions.text import battery_kwh, litres, model_by_rule, norm_fuel, norm_gearbox, norm_make, norm_model, power_in_text, slugify, strong_badges

#: Words of trims that tell twins of equal engine apart.
TRIM_WORDS = ("gti", "gtd", "gte", "gts", "gtx", "rs", "vrs", "cupra", "jcw", "competition", "clubsport", "performance", "abarth", "nismo", "polestar", "quadrifoglio", "gsi", "opc")
#: Hyphened names of equipment that become one word, so that they leave no single letters.
TRIM_COMPOUNDS = ("r-line", "s-line", "m-sport", "m-paket", "amg-line", "gt-line")
#: Numbers of a seller's title that can be horse power.
TITLE_POWER = (60, 900)


def words_of(text: Column) -> Column:
    """The parts of a text's slug, in order; none of a null text."""
    return F.filter(F.split(F.coalesce(slugify(text), F.lit("")), "-"), lambda t: t != "")


def _texts(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def trims_in_text(text: Column) -> Column:
    """The trim words of a listing's text, once compounds are closed up."""
    closed = text
    for compound in TRIM_COMPOUNDS:
        closed = F.regexp_replace(closed, f"(?i){compound}", compound.replace("-", ""))
    return F.array_distinct(F.filter(words_of(closed), lambda t: t.isin(*TRIM_WORDS)))


def trims_in_tokens(tokens: Column) -> Column:
    """The trim words among the tokens of a version's name, hyphens left out."""
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.replace(t, F.lit("-"), F.lit(""))), lambda t: t.isin(*TRIM_WORDS)))


def title_powers(title: Column) -> Column:
    """Numbers in a title that can be horse power: not those within a badge of it, and not those before kW or kWh."""

    def found(tokens: Column) -> Column:
        in_badges = F.flatten(F.transform(strong_badges(title, F.lit(None).cast("string")), lambda b: F.regexp_extract_all(b, F.lit(r"(\d+)"), F.lit(1))))
        values = F.transform(tokens, lambda t, i: F.when(t.rlike(r"^\d{1,4}$") & ~F.array_contains(in_badges, t) & ~F.coalesce(F.get(tokens, i + 1).startswith("kw"), F.lit(False)), t.cast("int")))
        return F.filter(F.array_compact(values), lambda n: n.between(*TITLE_POWER))

    return let(words_of(title), found)


def listing_signals(ads: DataFrame, families: DataFrame) -> DataFrame:
    """The rows that ``resolver.resolve`` takes, of ads (ad_id, make, model, variant, extra, fuel, year, power_hp, cc, gearbox, doors, co2, seller_title) as they come.

    ``families`` (make, family) are those of the catalog: a listing whose model and
    variant name none of them is tried by its model alone. Power comes from the texts
    where it isn't given. A badge that repeats the family is none. Listings without a
    known make, fuel or family are left out.
    """
    model, variant, extra = F.col("model"), F.col("variant"), F.col("extra")
    make = norm_make(F.col("make"))
    performance = F.when(make == "bmw", F.nullif(F.regexp_extract(slugify(model), r"^m([2-8])\d{2}", 1), F.lit("")))
    by_series = F.concat(F.lit("serie-"), performance)
    cleaned = ads.withColumns({
        "_make": make,
        "_fuel": norm_fuel(F.col("fuel"), variant, F.col("co2")),
        "_family": F.coalesce(by_series, norm_model(make, model, variant)),
        "_guess": by_series.isNull() & model_by_rule(make, model, variant).isNull(),
        "_plain": F.when(by_series.isNull(), norm_model(make, model)),
        "_plain_guess": model_by_rule(make, model).isNull(),
    })
    known = families.select("make", "family").distinct()
    first = known.select(F.col("make").alias("_make"), F.col("family").alias("_family"), F.lit(True).alias("_known"))
    second = known.select(F.col("make").alias("_make"), F.col("family").alias("_plain"), F.lit(True).alias("_known_plain"))
    met = cleaned.join(first, ["_make", "_family"], "left").join(second, ["_make", "_plain"], "left")
    plain = F.col("_known").isNull() & F.col("_known_plain").isNotNull()
    family = F.when(plain, F.col("_plain")).otherwise(F.col("_family"))
    title = F.col("seller_title")
    none = F.array().cast("array<string>")
    rows = met.where("_make is not null and _fuel is not null and _family is not null").select(
        "ad_id", F.col("_make").alias("make"), family.alias("family"), F.col("_fuel").alias("fuel"), "model",
        F.when(plain, F.col("_plain_guess")).otherwise(F.col("_guess")).alias("via_fallback"), "year",
        F.coalesce(F.col("power_hp"), power_in_text(_texts(variant, model))).cast("int").alias("power_hp"), F.col("cc").cast("int").alias("cc"),
        litres(variant).alias("litres"), battery_kwh(_texts(variant, extra)).alias("kwh"), strong_badges(model, variant).alias("badges"),
        words_of(_texts(model, variant, extra)).alias("tokens"), trims_in_text(_texts(model, variant, extra)).alias("trims"), norm_gearbox(F.col("gearbox")).alias("gearbox"), "doors", "co2",
        F.coalesce(strong_badges(title, F.lit(None).cast("string")), none).alias("title_badges"), F.coalesce(title_powers(title), F.array().cast("array<int>")).alias("title_powers"),
    )
    return rows.withColumn("badges", F.filter("badges", lambda b: b != F.col("family")))
