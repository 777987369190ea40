"""Registration tax, annual tax and landed cost as column expressions over versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorlake.functions.semantics import half_up, half_up_to

LINEAR = tuple[float | None, float, float]
STEP = tuple[float | None, float]


@dataclass(frozen=True)
class TaxTables:
    """Brackets of one year: (up to, rate, deduction) or (up to, amount); None is open."""

    year: int
    displacement: tuple[LINEAR, ...]
    co2: dict[tuple[str, str], tuple[LINEAR, ...]]
    age: tuple[tuple[float, float | None, int], ...]
    hybrid_pct: int
    plugin_pct: int
    intermediate_co2: int
    plugin_years: tuple[int, int]
    diesel: float
    annual_displacement: tuple[STEP, ...]
    annual_co2: dict[str, tuple[tuple[float | None, float, float], ...]]
    annual_coefficient: tuple[tuple[int | None, float], ...]
    annual_diesel: tuple[STEP, ...]


#: The tables of 2026.
TABLES_2026 = TaxTables(
    year=2026,
    displacement=((1000, 1.09, 849.03), (1250, 1.18, 850.69), (None, 5.61, 6194.88)),
    co2={
        ("petrol", "wltp"): ((110, 0.44, 43.02), (115, 1.1, 115.8), (120, 1.38, 147.79), (130, 5.27, 619.17), (145, 6.38, 762.73), (175, 41.54, 5819.56), (195, 51.38, 7247.39), (235, 193.01, 34190.52), (None, 233.81, 41910.96)),
        ("diesel", "wltp"): ((110, 1.72, 11.5), (120, 18.96, 1906.19), (140, 65.04, 7360.85), (150, 127.4, 16080.57), (160, 160.81, 21176.06), (170, 221.69, 29227.38), (190, 274.08, 36987.98), (None, 282.35, 38271.32)),
        ("petrol", "nedc"): ((99, 4.62, 427.0), (115, 8.09, 750.99), (145, 52.56, 5903.94), (175, 61.24, 7140.17), (195, 155.97, 23627.27), (None, 205.65, 33390.12)),
        ("diesel", "nedc"): ((79, 5.78, 439.04), (95, 23.45, 1848.58), (120, 79.22, 7195.63), (140, 175.73, 18924.92), (160, 195.43, 21720.92), (None, 268.42, 33447.9)),
    },
    age=((0, 1, 10), (1, 2, 20), (2, 3, 28), (3, 4, 35), (4, 5, 43), (5, 6, 52), (6, 7, 60), (7, 8, 65), (8, 9, 70), (9, 10, 75), (10, None, 80)),
    hybrid_pct=60,
    plugin_pct=25,
    intermediate_co2=50,
    plugin_years=(2015, 2020),
    diesel=500.0,
    annual_displacement=((1250, 31.77), (1750, 63.74), (2500, 127.35), (None, 435.84)),
    annual_co2={"wltp": ((140, 65.15, 0.0), (205, 97.63, 0.0), (260, 212.04, 31.77), (None, 363.25, 63.74)), "nedc": ((120, 65.15, 0.0), (180, 97.63, 0.0), (250, 212.04, 31.77), (None, 363.25, 63.74))},
    annual_coefficient=((2007, 1.0), (2008, 1.05), (2009, 1.1), (None, 1.15)),
    annual_diesel=((1250, 5.02), (1750, 10.07), (2500, 20.12), (None, 68.85)),
)
TABLES = {2026: TABLES_2026}

#: Transport in EUR by country; the parts of the legalisation fee.
TRANSPORT = {"DE": 1100, "NL": 1000, "BE": 950, "FR": 800, "ES": 450}
LEGALISATION = 120 + 45 + 165 + 25

#: Fuels as listings name them.
PETROL, DIESEL, HYBRID, PLUGIN, ELECTRIC = "gasolina", "diesel", "híbrido", "phev", "elétrico"


def tables_of(year: int) -> TaxTables:
    """The tables of a year; without them nothing is computed."""
    if year not in TABLES:
        raise ValueError(f"no tax tables for {year}")
    return TABLES[year]


def _pick(units: Column, brackets, value) -> Column:
    """The value of the first bracket that reaches up to ``units``."""
    out = value(brackets[-1])
    for bracket in reversed(brackets[:-1]):
        out = F.when(units <= bracket[0], value(bracket)).otherwise(out)
    return out


def _linear(units: Column, brackets: tuple[LINEAR, ...]) -> Column:
    return F.greatest(F.lit(0.0), _pick(units, brackets, lambda b: units * F.lit(float(b[1])) - F.lit(float(b[2]))))


def _step(units: Column, brackets) -> Column:
    return _pick(units, brackets, lambda b: F.lit(float(b[1])))


def norm(year: Column) -> Column:
    return F.when(year >= 2019, "wltp").otherwise("nedc")


def age_years(first_registration: Column, reference: Column) -> Column:
    """Exact seconds over years of 365.25 days."""
    return (F.unix_timestamp(reference.cast("timestamp")) - F.unix_timestamp(first_registration.cast("timestamp"))) / F.lit(365.25 * 86400)


def reduction_pct(age: Column, tables: TaxTables = TABLES_2026) -> Column:
    out = F.lit(0)
    for low, high, pct in tables.age:
        out = F.when((age >= low) & (age < high if high is not None else F.lit(True)), pct).otherwise(out)
    return out


def registration_tax(fuel: Column, cc: Column, co2: Column, year: Column, age: Column, tables: TaxTables = TABLES_2026) -> dict[str, Column]:
    """Parts and total of the registration tax; all null for other than electric vehicles without displacement or CO2."""
    electric, diesel = fuel == ELECTRIC, fuel == DIESEL
    by_displacement = _linear(cc, tables.displacement)
    wltp = norm(year) == "wltp"
    by_co2 = F.when(diesel & wltp, _linear(co2, tables.co2["diesel", "wltp"])).when(diesel, _linear(co2, tables.co2["diesel", "nedc"])).when(wltp, _linear(co2, tables.co2["petrol", "wltp"])).otherwise(_linear(co2, tables.co2["petrol", "nedc"]))
    low = co2 < tables.intermediate_co2
    rate = F.when((fuel == PLUGIN) & (year.between(*tables.plugin_years) | low), tables.plugin_pct).when((fuel == HYBRID) & low, tables.hybrid_pct).otherwise(100)
    surcharge = F.when(diesel, tables.diesel).otherwise(0.0)
    less = reduction_pct(age, tables)
    total = ((by_displacement + by_co2) * (rate / F.lit(100.0)) + surcharge) * (F.lit(1.0) - less / F.lit(100.0))
    known = cc.isNotNull() & co2.isNotNull()
    part = lambda x, zero=0.0: F.when(electric, F.lit(zero)).when(known, x)
    notes = F.array_compact(
        F.array(
            F.when(~electric & year.isin(2018, 2019), F.concat(F.lit("norm:"), norm(year))),
            F.when(fuel.isin(HYBRID, PLUGIN), "petrol-table"),
            F.when(diesel, "particulate-surcharge"),
            F.when(rate < 100, F.concat(F.lit("intermediate:"), rate.cast("string"))),
        )
    )
    return {
        "isv_displacement": part(half_up_to(by_displacement, 2)),
        "isv_co2": part(half_up_to(by_co2, 2)),
        "isv_surcharge": part(surcharge),
        "isv_rate_pct": part(rate, 0),
        "isv_reduction_pct": part(less, 0),
        "isv": part(half_up_to(total, 2)),
        "assumptions": notes,
    }


def annual_tax(fuel: Column, cc: Column, co2: Column, year: Column, tables: TaxTables = TABLES_2026) -> Column:
    bracket = lambda i: F.when(norm(year) == "wltp", _pick(co2, tables.annual_co2["wltp"], lambda b: F.lit(float(b[i])))).otherwise(_pick(co2, tables.annual_co2["nedc"], lambda b: F.lit(float(b[i]))))
    by_co2 = bracket(1) + F.when(year >= 2017, bracket(2)).otherwise(0.0)
    coefficient = _step(year, tables.annual_coefficient)
    diesel = F.when(fuel == DIESEL, _step(cc, tables.annual_diesel)).otherwise(0.0)
    total = half_up_to((_step(cc, tables.annual_displacement) + by_co2) * coefficient + diesel, 2)
    return F.when(fuel == ELECTRIC, 0.0).when(cc.isNotNull() & co2.isNotNull(), total)


def transport(country: Column) -> Column:
    out = F.lit(None).cast("int")
    for code, eur in TRANSPORT.items():
        out = F.when(country == code, eur).otherwise(out)
    return out


def landed_cost(price: Column, country: Column, isv: Column, annual: Column) -> Column:
    return (price + transport(country) + half_up(isv) + half_up(annual) + F.lit(LEGALISATION)).cast("bigint")


def verdict(savings_pct: Column) -> Column:
    return F.when(savings_pct >= 7, "compensa").when(savings_pct >= 2, "marginal").when(savings_pct.isNotNull(), "nao_compensa")


def savings_pct(savings: Column, home_price: Column) -> Column:
    """In percent with one decimal, halves up."""
    return half_up((savings / home_price) * F.lit(1000.0)) / F.lit(10.0)
