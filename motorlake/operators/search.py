"""Faceted search over the showcase: filters as one conjunction, a total order, pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 24
LAST_PAGE = 200
MOST_TOKENS = 6
#: Rows that a task should sort at once, and the most parts: beyond 200, the writers of a shuffle hold their rows in memory.
PART_ROWS = 100_000
MOST_PARTS = 200
SORTS = ("savingsPct", "savings", "price", "recent")
COUNTRIES = ("DE", "FR", "NL", "BE", "ES")
FUELS = ("gasolina", "diesel", "híbrido", "phev", "elétrico")
GEARBOXES = ("manual", "auto")
VERDICTS = ("compensa", "marginal", "nao_compensa")


@dataclass(frozen=True)
class Filters:
    text: str = ""
    countries: tuple[str, ...] = field(default=())
    verdict: str | None = None
    max_total: int | None = None
    min_year: int | None = None
    max_km: int | None = None
    fuel: str | None = None
    gearbox: str | None = None
    sort: str = "savingsPct"
    page: int = 1

    @classmethod
    def parse(cls, query: str) -> Filters:
        """From a URL query; what isn't valid is left out."""
        given = parse_qs(query)
        one = lambda k: given.get(k, [""])[-1]
        number = lambda k: int(one(k)) if one(k).isascii() and one(k).isdigit() else None
        known = lambda k, values: one(k) if one(k) in values else None
        countries = tuple(dict.fromkeys(c for v in given.get("country", []) for c in v.split(",") if c in COUNTRIES))
        page = min(max(number("page") or 1, 1), LAST_PAGE)
        return cls(one("q").strip(), countries, known("verdict", VERDICTS), number("maxTotal"), number("minYear"), number("maxKm"), known("fuel", FUELS), known("gearbox", GEARBOXES), known("sort", SORTS) or "savingsPct", page)

    def url(self) -> str:
        """The inverse of parse(); defaults are left out."""
        pairs = [("q", self.text), *[("country", c) for c in self.countries], ("verdict", self.verdict), ("maxTotal", self.max_total), ("minYear", self.min_year), ("maxKm", self.max_km), ("fuel", self.fuel), ("gearbox", self.gearbox)]
        pairs += [("sort", self.sort)] * (self.sort != "savingsPct") + [("page", self.page)] * (self.page != 1)
        return urlencode([(k, v) for k, v in pairs if v not in (None, "")])

    def conditions(self, searched: list[str], named: dict[str, str] | None = None) -> Column:
        """One condition over country, verdict, total_home, year, km, fuel, gearbox and the ``searched`` text columns; ``named`` says which of them have other names. Unknown values fit no facet."""
        tests = [F.lit(True)]
        column = lambda name: F.col((named or {}).get(name, name))
        tests += [F.col("country").isin(*self.countries)] * bool(self.countries)
        for name, value in (("verdict", self.verdict), ("fuel", self.fuel), ("gearbox", self.gearbox)):
            tests += [column(name) == value] * (value is not None)
        tests += [column("total_home") <= self.max_total] * (self.max_total is not None)
        tests += [F.col("year") >= self.min_year] * (self.min_year is not None)
        tests += [F.col("km") <= self.max_km] * (self.max_km is not None)
        body = F.lower(F.concat_ws(" ", *searched))
        tests += [F.contains(body, F.lit(token)) for token in self.text.lower().split()[:MOST_TOKENS]]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return F.coalesce(out, F.lit(False))

    def order(self) -> list[Column]:
        """By the key, then by id, so that pages never overlap."""
        keys = {"savingsPct": F.col("savings_pct").desc_nulls_first(), "savings": F.col("savings").desc_nulls_first(), "price": F.col("price").asc_nulls_last(), "recent": F.col("observed_at").desc_nulls_first()}
        return [keys[self.sort], F.col("id").asc()]


def representatives(rows: DataFrame, identity: Column, most: int | None = None) -> DataFrame:
    """One row for each vehicle: the one that saves most, of equals the smallest id.

    Rows are dealt out by vehicle before they are sorted, so that a task sorts its part of a
    shuffle and not a part of the input or of a model. ``most``, how many rows there may be,
    gives the number of parts, so that there are more of them and not larger ones where
    tables grow, up to MOST_PARTS; without it the session decides.
    """
    best = Window.partitionBy("_identity").orderBy(F.col("savings_pct").desc(), "id")
    parts = [] if most is None else [min(max(1, -(-most // PART_ROWS)), MOST_PARTS)]
    return rows.withColumn("_identity", identity).repartition(*parts, "_identity").withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_identity", "_place")


def page(rows: DataFrame, filters: Filters, searched: list[str]) -> DataFrame:
    """The rows of one page."""
    return rows.where(filters.conditions(searched)).orderBy(*filters.order()).offset((filters.page - 1) * PAGE).limit(PAGE)


def total(rows: DataFrame, filters: Filters, searched: list[str]) -> DataFrame:
    """How many rows fit, apart from the page so that no window has to see all rows."""
    return rows.where(filters.conditions(searched)).agg(F.count("*").alias("total"))


def in_order(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the given ids with their place in the list; unknown ids are left out."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "id string, place int")
    return rows.join(wanted, "id")
