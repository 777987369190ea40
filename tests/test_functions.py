"""Column functions against known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from motorlake.functions import semantics, tax, text
from motorlake.functions.identity import car_identity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def of(spark, function, *values, kind="string"):
    return one(spark, function(*[F.lit(v).cast(kind) for v in values]))


@pytest.mark.parametrize(("value", "even", "up"), [(2.5, 2, 3), (3.5, 4, 4), (-2.5, -2, -2), (0.4, 0, 0)])
def test_rounding(spark, value, even, up):
    assert one(spark, semantics.half_even_int(F.lit(value))) == even
    assert one(spark, semantics.half_up(F.lit(value))) == up


@pytest.mark.parametrize(
    ("fuel", "cc", "co2", "registered", "total"),
    [("gasolina", 998, 105, "2016-01-15", None), ("elétrico", None, None, "2022-01-01", 0.0), ("gasolina", None, 100, "2022-01-01", None)],
)
def test_registration_tax_edges(spark, fuel, cc, co2, registered, total):
    age = tax.age_years(F.lit(dt.date.fromisoformat(registered)), F.lit(dt.date(2026, 7, 14)))
    parts = tax.registration_tax(F.lit(fuel), F.lit(cc).cast("int"), F.lit(co2).cast("int"), F.lit(int(registered[:4])), age)
    got = one(spark, parts["isv"])
    if cc == 998:
        assert one(spark, parts["isv_displacement"]) == 238.79
        assert one(spark, parts["isv_co2"]) == 98.46
    else:
        assert got == total


@pytest.mark.parametrize(("cc", "value"), [(1000, 240.97), (1001, 330.49), (1250, 624.31), (1251, 823.23)])
def test_displacement_brackets(spark, cc, value):
    parts = tax.registration_tax(F.lit("gasolina"), F.lit(cc), F.lit(0), F.lit(2020), F.lit(0.5))
    assert one(spark, parts["isv_displacement"]) == pytest.approx(value, abs=0.005)


@pytest.mark.parametrize(("year", "co2", "rate"), [(2018, 80, 25), (2021, 49, 25), (2021, 50, 100)])
def test_plug_in_rates(spark, year, co2, rate):
    parts = tax.registration_tax(F.lit("phev"), F.lit(1500), F.lit(co2), F.lit(year), F.lit(3.0))
    assert one(spark, parts["isv_rate_pct"]) == rate


def test_age_reduction_is_complete(spark):
    got = [r[0] for r in spark.createDataFrame([(a / 2,) for a in range(0, 24)], "a double").select(tax.reduction_pct(F.col("a"))).collect()]
    assert got == [p for p in (10, 20, 28, 35, 43, 52, 60, 65, 70, 75, 80, 80) for _ in range(2)]
    assert one(spark, tax.reduction_pct(F.lit(-0.1))) == 0


def test_missing_tables_fail():
    with pytest.raises(ValueError):
        tax.tables_of(1999)


@pytest.mark.parametrize(("pct", "name"), [(7.0, "compensa"), (6.9, "marginal"), (2.0, "marginal"), (1.9, "nao_compensa"), (-3.0, "nao_compensa")])
def test_verdict(spark, pct, name):
    assert one(spark, tax.verdict(F.lit(pct))) == name


@pytest.mark.parametrize(("raw", "slug"), [("Citroën", "citroen"), ("  Škoda Octavia! ", "skoda-octavia"), ("---", ""), ("ÇA va", "ca-va"), ("ñandú", "nandu"), (None, None)])
def test_slugify(spark, raw, slug):
    assert of(spark, text.slugify, raw) == slug


@pytest.mark.parametrize(
    ("make", "model", "variant", "family"),
    [
        ("bmw", "3er Touring", None, "serie-3"), ("bmw", "320d", None, "serie-3"), ("bmw", "X5 xDrive", None, "x5"), ("mercedes", "C 220 d", None, "classe-c"), ("mercedes", "Clase A", None, "classe-a"),
        ("mercedes", "GLC 220", None, "glc"), ("audi", "RS3 Sportback", None, "a3"), ("audi", "RS Q3", None, "q3"), ("volkswagen", "Golf Sportsvan", None, "golf-sportsvan"), ("volkswagen", "Golf", "VII", "golf"),
        ("mini", "Mini", "Countryman E", "countryman"), ("byd", "Seal U", None, "seal-u"), ("peugeot", "308 SW", None, "308"), ("nobody", "Thing One", None, "thing"), ("kia", "Cee'd", None, "ceed"), ("bmw", "", None, None),
    ],
)
def test_model(spark, make, model, variant, family):
    assert of(spark, text.norm_model, make, model, variant) == family


@pytest.mark.parametrize(
    ("raw", "variant", "co2", "fuel"),
    [("Elektro/Benzin", None, 100, "híbrido"), ("Elektro/Benzin", None, 45, "phev"), ("Hibrido", "300 e", None, "phev"), ("Hybrid", "145 e-DCS6", None, "híbrido"), ("Gasolina", "1.6 HEV", None, "híbrido"), ("Gasolina", "mild hybrid", None, "gasolina"), ("Elektro", None, None, "elétrico"), ("GPL", None, None, None), ("Gas", None, None, None), ("D", None, None, "diesel")],
)
def test_fuel(spark, raw, variant, co2, fuel):
    assert one(spark, text.norm_fuel(F.lit(raw), F.lit(variant).cast("string"), F.lit(co2).cast("int"))) == fuel


@pytest.mark.parametrize(("said", "hp"), [("145cv", 145), ("333 CH", 333), ("100 kW", 136), ("840I 3.0 333 XDRIVE", 333), ("nothing", None), ("9 cv", None), ("1200 hp", 200), (None, None)])
def test_power(spark, said, hp):
    assert of(spark, text.power_in_text, said) == hp


@pytest.mark.parametrize(("engine", "cc"), [("3.0 Gasoline", 3000), ("2,0 l", 2000), ("V8 4.4 Gasoline", 4400), ("1.995 cm³", 1995), ("1995", 1995), ("TDI", None), ("99999", None), (None, None)])
def test_displacement(spark, engine, cc):
    assert of(spark, text.displacement, engine) == cc


@pytest.mark.parametrize(("raw", "gearbox"), [("Halbautomatik", None), ("Automatic", "auto"), ("Schaltgetriebe", "manual"), ("AUTO", "auto"), ("Mecánica", "manual"), ("", None), (None, None)])
def test_gearbox(spark, raw, gearbox):
    assert of(spark, text.norm_gearbox, raw) == gearbox


@pytest.mark.parametrize(("raw", "date"), [("2020-05-17", dt.date(2020, 5, 17)), ("2020-05", dt.date(2020, 5, 1)), ("3/2019", dt.date(2019, 3, 1)), ("2020-13-01", None), ("soon", None)])
def test_first_registration(spark, raw, date):
    assert of(spark, text.first_registration, raw) == date


@pytest.mark.parametrize(("said", "minutes"), [("Hace 21 h 21 minutos", 1281), ("Hace 3 días", 4320), ("Hace 45 minutos", 45), ("hoy", None)])
def test_ago(spark, said, minutes):
    assert of(spark, text.ago_minutes, said) == minutes


def test_cash_price(spark):
    ask = lambda said, listed: one(spark, text.cash_price(F.lit(said), F.lit(listed)))
    assert ask("al contado 21.000 €, al contado: 22.000 €, al contado 22.000", 20000) == 22000
    assert ask("al contado 21.000 o al contado 22.000", 20000) == 21000
    assert ask("al contado 19.000 y al contado 99.000", 20000) is None


def test_identity(spark):
    ask = lambda vin, url: one(spark, car_identity(F.lit(vin).cast("string"), F.lit(url).cast("string"), F.lit("m"), F.lit(2020), F.lit(44500), F.lit(100)))
    assert ask("wvw1", None) == "WVW1"
    assert ask(None, "https://x.pt/car-wvwzzz1kzaw000001/") == "WVWZZZ1KZAW000001"
    assert ask(None, "https://x.pt/car") == "m:2020:45000:100"


def test_territory(spark):
    ask = lambda *v: of(spark, text.excluded_territory, *v)
    assert ask("ES", None, "07001") and ask("ES", "Las Palmas", None)
    assert not ask("DE", None, "07001") and not ask("ES", None, None) and not ask("ES", "Palma del Río", None) and not ask(None, None, None)


def test_badges(spark):
    assert sorted(of(spark, text.strong_badges, "320d", "xDrive 45 GTI")) == ["320d", "xdrive45"]


def test_vehicles_are_dealt_out_before_they_are_sorted(spark):
    """The sort of representatives() runs in parts of a shuffle, never in parts of the input, which can be much larger."""
    from motorlake.operators import search

    rows = spark.range(0, 1000, 1, 2).select("id", (F.col("id") % 10).alias("savings_pct"), (F.col("id") % 7).cast("string").alias("vehicle"))
    chosen = search.representatives(rows, F.col("vehicle"))
    below = chosen._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(_identity")[2]
    assert below and "Sort [" not in below and "WindowGroupLimit" not in below
    assert sorted(r["id"] for r in chosen.collect()) == [9, 19, 29, 39, 49, 59, 69]


def test_parts_of_vehicles_are_as_many_as_the_rows_need(spark, small, monkeypatch):
    """Where tables grow, a task of representatives() sorts no more rows; parts are more, up to a limit, and the result is the same."""
    from motorlake.operators import search
    from motorlake.plans import search_queries

    rows = spark.range(0, 1000, 1, 2).select("id", (F.col("id") % 10).alias("savings_pct"), (F.col("id") % 7).cast("string").alias("vehicle"))
    monkeypatch.setattr(search, "PART_ROWS", 100)
    parts = lambda most: search.representatives(rows, F.col("vehicle"), most).rdd.getNumPartitions()
    assert [parts(n) for n in (0, 100, 901, 1000, 10**6)] == [1, 1, 10, 10, search.MOST_PARTS]
    assert sorted(r["id"] for r in search.representatives(rows, F.col("vehicle"), 1000).collect()) == [9, 19, 29, 39, 49, 59, 69]
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert search_queries.showcase(spark, small).rdd.getNumPartitions() == min(-(-lines // 100), search.MOST_PARTS) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_parts_meet_their_lines_without_a_sort(spark, small, monkeypatch):
    """Lines are as many times more than parts as tables are large; a task that sorts them needs memory for its share of them."""
    from motorlake.sources import tables

    few = tables.listings(spark, small)
    monkeypatch.setattr(tables, "SENT_PARTS", 0)
    many = tables.listings(spark, small)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
