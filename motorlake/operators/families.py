"""Families of catalog models: a table of rules, of which the first that fits a model's make and slug decides.

Models meet the rules of their make in one join; what fits is a condition on the pattern
in the row, and the smallest place wins. A new make or spelling is a row, no code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.functions.text import FAMILIES, norm_make, rules_of, slugify

#: Names of Mercedes models that stand anywhere in a slug and are families of their own, in order.
MERCEDES_NAMES = (
    "maybach", "amg-gt", "cla", "clb", "cls", "clk", "clc", "cle", "gla", "glb", "glc", "gle", "gls", "glk", "gl", "ml", "slk", "slc", "slr", "sls", "sl",
    "eqa", "eqb", "eqc", "eqe", "eqs", "eqv", "eqt", "citan", "vito", "viano", "vaneo", "sprinter",
)
#: Letters of Mercedes classes in order, with their families.
MERCEDES_CLASSES = (("a", "classe-a"), ("b", "classe-b"), ("c", "classe-c"), ("e", "classe-e"), ("s", "classe-s"), ("g", "g"), ("v", "v"), ("t", "t"), ("r", "r"))
#: Chassis codes of MINI families.
MINI_CODES = (
    ("mini-cooper", ("r50", "r53", "r56", "f55", "f56", "f66", "j01")),
    ("countryman", ("r60", "f60", "u25")),
    ("clubman", ("r55", "f54")),
    ("mini-cabrio", ("r52", "r57", "f57", "f67")),
)
#: Chassis codes ahead of the model's name, by make; they are no part of it.
CHASSIS_AHEAD = (("bmw", r"^[efgu]\d{2,3}-(lci-)?"), ("land-rover", r"^l\d{3}-"))
#: The parts of a Transporter's slug, and slugs whose family is given by hand.
TRANSPORTER = r"^t(?:5\d?|6\d?|7)(?:-|$)"
BY_HAND = (("mercedes", "c-w203-sportcoupe", "classe-c"),)

RULE = "make string, place int, pattern string, family string, rule string"
#: The rule's name for families that a make's own patterns give, and for those that are only a first word.
BY_PATTERN, BY_FIRST_WORD = "normmodel:rule", "normmodel:fallback"


def _rows() -> list[tuple[str, str, str, str]]:
    """(make, pattern, family, rule) in order; a family may hold $1, what the pattern's group found."""
    word = lambda names: rf"(?:^|-)(?:{names})(?:-|$)"
    rows = [(make, f"^{slug}$", family, "exception") for make, slug, family in BY_HAND]
    rows += [("mercedes", word(name), name, f"mb:{name}") for name in MERCEDES_NAMES]
    rows += [("mercedes", word("eurovan?"), "eurovan", "mb:eurovan"), ("mercedes", word("x-class|class-x"), "x", "mb:x")]
    rows += [("mercedes", word(f"{c}-class|class-{c}") + rf"|^{c}-[wcsavxrhnz]\d", family, f"mb:class-{c}") for c, family in MERCEDES_CLASSES]
    rows += [("mercedes", r"(?:^|-)([a-z]\d{2,3})(?:-|$)", "$1", "mb:chassis-only"), ("mercedes", "^([^-]+)", "$1", "mb:fallback")]
    codes = "|".join(c for _, own in MINI_CODES for c in own)
    rows += [("mini", rf"^(?=[rfju]\d)(?:(?!(?:{codes})(?:-|$))[^-]+-)*(?:{'|'.join(own)})(?:-|$)", family, "mini:chassis") for family, own in MINI_CODES]
    rows += [("volkswagen", TRANSPORTER, "transporter", "vw:transporter")]
    return rows + [(make, pattern, family, BY_PATTERN) for make in FAMILIES for pattern, family in rules_of(make)]


def rules(spark: SparkSession) -> DataFrame:
    """The table of rules; its size is that of the lists above."""
    return spark.createDataFrame([(make, place, *rest) for place, (make, *rest) in enumerate(_rows())], RULE)


def with_families(models: DataFrame, strict: bool = False) -> DataFrame:
    """``models`` (make, slug, ...) with family and rule, found once for each make and slug.

    A family that is no more than the first word is told by its rule. What no rule
    resolves, for want of a make or of any letter or digit, has null for both, or fails
    the job where ``strict``, so that somebody looks at new slugs.
    """
    slug = slugify(F.col("slug"))
    asked = models.select("make", "slug").distinct().select(F.col("make").alias("_make"), F.col("slug").alias("_slug"), norm_make(F.col("make")).alias("key"), slug.alias("whole"))
    core = F.col("whole")
    for make, pattern in CHASSIS_AHEAD:
        core = F.when(F.col("key") == make, F.regexp_replace(F.col("whole"), pattern, "")).otherwise(core)
    asked = asked.where((F.col("key") != "") & (F.col("whole") != "")).withColumn("core", core)
    found = asked.join(F.broadcast(rules(models.sparkSession)).withColumnRenamed("make", "key"), "key").where(F.expr("core rlike pattern"))
    first = found.groupBy("_make", "_slug").agg(F.min_by(F.struct("pattern", "family", "rule"), "place").alias("r"))
    named = asked.join(first, ["_make", "_slug"], "left")
    group = F.expr("CASE WHEN contains(r.family, '$1') THEN replace(r.family, '$1', regexp_extract(core, r.pattern, 1)) ELSE r.family END")
    word = F.nullif(F.substring_index("core", "-", 1), F.lit(""))
    told = named.select("_make", "_slug", "r.rule", F.coalesce(group, word).alias("family"), word.alias("word"))
    by_name = F.coalesce(F.col("rule"), F.lit(BY_PATTERN)) == BY_PATTERN
    rule = F.when(by_name & (F.col("family") == F.col("word")), BY_FIRST_WORD).otherwise(F.col("rule"))
    told = told.select("_make", "_slug", "family", F.when(F.col("family").isNotNull(), rule).alias("rule"))
    out = models.join(told, models["make"].eqNullSafe(F.col("_make")) & models["slug"].eqNullSafe(F.col("_slug")), "left").drop("_make", "_slug")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("no family for "), F.coalesce("make", F.lit("?")), F.lit("/"), F.coalesce("slug", F.lit("?")))).cast("string")
        out = out.withColumn("family", F.coalesce("family", unknown))
    return out
