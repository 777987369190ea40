"""Extractors over the pages of a specification site: sections of versions, and spec sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlake.functions.semantics import capture
from motorlake.sources.pages import strip_tags

#: The labels of a spec sheet by column and type, as patterns over the label's start.
SHEET = {
    "generation": ("Generation$", "string"),
    "body": ("Body$", "string"),
    "doors": ("Num\\. of Doors", "number"),
    "seats": ("Num\\. of Seats", "number"),
    "fuel": ("Fuel type$", "string"),
    "engine_code": ("Engine Code$", "string"),
    "cylinders": ("Engine type - Number of cylinders", "string"),
    "torque_nm": ("Maximum torque", "number"),
    "drivetrain": ("Drive wheels", "string"),
    "gearbox": ("Transmission Gearbox", "string"),
    "co2_wltp": ("CO2 emissions WLTP", "number"),
    "co2_nedc": ("CO2 emissions(?! WLTP)", "number"),
    "emission_standard": ("Emission standard", "string"),
    "curb_weight_kg": ("Curb Weight", "number"),
}


def first_number(text: Column) -> Column:
    """The first number, or null; the first comma of the text is a decimal point."""
    return capture(F.regexp_replace(text, "^([^,]*),", "$1."), r"(-?[0-9]+(?:\.[0-9]+)?)").try_cast("double")


def version_rows(pages: DataFrame, key: str) -> DataFrame:
    """(key, section, version_id, path, name, year, power_hp, power_kw, displacement_cc) of the rows that link a version, by section of fuel."""
    section = r"(?s)<div class=['\"]versions_div['\"] id=['\"](\w+)_engines['\"]>(.*?)(?=<div class=['\"]versions_div['\"]|</section|$)"
    parts = lambda group: F.regexp_extract_all("html", F.lit(section), F.lit(group))
    sections = pages.select(key, F.explode(F.arrays_zip(parts(1).alias("section"), parts(2).alias("body"))).alias("_s")).select(key, "_s.section", "_s.body")
    lines = sections.select(key, "section", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("_row"))
    cells = lines.select(key, "section", F.regexp_extract_all("_row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("_cells"))
    link = r'(?s)href="(/car-specs/[^/]+/([0-9]+)/[^"]+\.html)"[^>]*>(.*?)</a>'
    cell = lambda i: F.get("_cells", F.lit(i))
    rows = cells.where(cell(0).rlike(link))
    return rows.select(
        key, "section", F.regexp_extract(cell(0), link, 2).alias("version_id"), F.regexp_extract(cell(0), link, 1).alias("path"), strip_tags(F.regexp_extract(cell(0), link, 3)).alias("name"),
        first_number(strip_tags(cell(1))).cast("int").alias("year"), first_number(strip_tags(cell(2))).alias("power_hp"), capture(strip_tags(cell(2)), r"(?i)([0-9]+(?:\.[0-9]+)?)\s*kW").try_cast("double").alias("power_kw"), first_number(strip_tags(cell(3))).alias("displacement_cc"),
    )


def sheet_rows(html: Column) -> Column:
    """An array of (label, value) of a spec sheet in page order, without the colon of labels and without values "-"."""
    row = r'(?s)<td[^>]*class="tabletd"[^>]*>(.*?)</td>\s*<td[^>]*class="tabletd_right"[^>]*>(.*?)</td>'
    labels = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(1)), lambda s: F.regexp_replace(strip_tags(s), r"\s*:\s*$", ""))
    values = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(2)), strip_tags)
    return F.filter(F.arrays_zip(labels.alias("label"), values.alias("value")), lambda x: (x["label"] != "") & ~x["value"].isin("-", ""))


def spec_sheet(pages: DataFrame, key: str) -> DataFrame:
    """``key`` and the columns of SHEET, each from the first label that fits; numbers are the first one of the value."""
    read = pages.select(key, sheet_rows(F.col("html")).alias("_rows"))

    def value(pattern: str, kind: str) -> Column:
        found = F.get(F.filter("_rows", lambda x: x["label"].rlike(f"(?i)^(?:{pattern})")), F.lit(0))["value"]
        return first_number(found) if kind == "number" else found

    return read.select(key, *[value(*rule).alias(name) for name, rule in SHEET.items()])
