"""What the resolver reads of raw listings, and listings resolved against a built catalog."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorlake.operators import catalog_build, resolver, signals

ADS = "ad_id string, make string, model string, variant string, extra string, fuel string, year int, power_hp int, cc int, gearbox string, doors int, co2 int, seller_title string"
NAMES = [x.split()[0] for x in ADS.split(", ")]
MODELS = "mid string, make string, slug string, model_year int"
VERSIONS = "version_id string, mid string, name string, section string, fuel string, year int, power_hp int, power_kw int, cc int, co2_wltp int, co2_nedc int, doors int, gearbox string, engine_code string"
VERSION_NAMES = [x.split()[0] for x in VERSIONS.split(", ")]


def version(version_id, mid, name, section, year, power, cc, **more):
    return tuple((dict.fromkeys(VERSION_NAMES) | dict(version_id=version_id, mid=mid, name=name, section=section, year=year, power_hp=power, cc=cc) | more)[c] for c in VERSION_NAMES)


@pytest.fixture(scope="module")
def catalog(spark):
    models = [
        ("G7", "Volkswagen", "Golf-7", 2012), ("G7V", "Volkswagen", "Golf-7-Variant", 2013), ("GT", "BMW", "F46-2-Series-Gran-Tourer", 2015), ("GC", "BMW", "F44-2-Series-Gran-Coupe", 2015),
        ("S8", "BMW", "G15-8-Series-Coupe", 2018), ("S8C", "BMW", "G14-8-Series-Cabrio", 2018), ("ID3", "Volkswagen", "ID.3", 2020), ("SF", "Hyundai", "Grand-Santa-Fe", 2013), ("D9", "Land Rover", "L663-Defender-90", 2020), ("D11", "Land Rover", "L663-Defender-110", 2020), ("S3", "BMW", "G20-3-Series", 2019),
    ]
    versions = [
        version("1", "G7", "Golf 7 GTI", "petrol", 2014, 230, 1984, doors=5, gearbox="6 speed Manual", co2_nedc=140), version("2", "G7", "Golf 7 GTI", "petrol", 2014, 230, 1984, doors=3, gearbox="DSG", co2_nedc=150),
        version("3", "G7", "Golf 7 GTI Clubsport", "petrol", 2016, 230, 1984, doors=5, gearbox="DSG"), version("4", "G7V", "Golf 7 Variant 1.4 TSI", "petrol", 2014, 125, 1395), version("5", "G7", "Golf 7 1.4 TSI", "petrol", 2014, 125, 1395),
        version("10", "GT", "216d", "diesel", 2016, 116, 1496), version("11", "GC", "216d", "diesel", 2016, 116, 1496), version("20", "S8", "840i", "petrol", 2019, 340, 2998), version("21", "S8C", "840i", "petrol", 2019, 340, 2998),
        version("30", "ID3", "ID.3 Pro", "electric", 2021, 204, 58), version("31", "ID3", "ID.3 Pro S", "electric", 2021, 204, 77), version("40", "SF", "2.2 CRDi", "diesel", 2014, 200, 2199), version("50", "D9", "P300", "petrol", 2021, 300, 1997), version("51", "D11", "P300", "petrol", 2021, 300, 1997),
        version("60", "S3", "320d xDrive", "diesel", 2020, 190, 1995),
    ]
    return catalog_build.build(spark.createDataFrame(models, MODELS), spark.createDataFrame(versions, VERSIONS))


PLAIN = dict.fromkeys(NAMES) | dict(make="VW", model="Golf VII", fuel="Benzin", year=2016)
CASES = {
    "the same trim words leave the plain GTI": (dict(variant="2.0 GTI 230 PS", doors=5), ("exact", "1")),
    "more trim words": (dict(variant="2.0 GTI Clubsport 230 PS"), ("exact", "3")),
    "the gearbox tells twins apart": (dict(variant="2.0 GTI 230 PS", gearbox="Schaltgetriebe"), ("exact", "1")),
    "doors tell twins apart": (dict(variant="2.0 GTI 230 PS", doors=3), ("exact", "2")),
    "emissions tell twins apart": (dict(variant="2.0 GTI 230 PS", co2=149), ("exact", "2")),
    "an equipment line is no trim": (dict(variant="2.0 GTI R-Line 230 PS", doors=3), ("exact", "2")),
    "a plain body without its word": (dict(variant="1.4 TSI 125 PS"), ("exact", "5")),
    "a body by its word in the title": (dict(variant="1.4 TSI 125 PS", extra="golf variant"), ("exact", "4")),
    "a derivative named in full": (dict(make="BMW", model="216d Gran Tourer", fuel="diesel", cc=1496), ("exact", "10")),
    "bodies alone leave the designation": (dict(make="BMW", model="840i", fuel="benzin", year=2020, power_hp=340, cc=2998), ("designation", None)),
    "models that no word tells apart aren't proven": (dict(make="Land Rover", model="Defender", variant="P300 2.0", fuel="benzin", year=2022, power_hp=300), ("probable", "50")),
    "battery and power of an electric car": (dict(model="ID.3", variant="Pro 204 PS", extra="58 kWh", fuel="Elektro", year=2021), ("exact", "30")),
    "another battery is proof against": (dict(model="ID.3", variant="204 PS", extra="45 kWh", fuel="Elektro", year=2021), None),
    "a first word guessed wrong": (dict(make="Hyundai", model="Grand i10", fuel="diesel", year=2015, power_hp=200, cc=2199), None),
    "a seller's title of another car": (dict(make="BMW", model="840i", fuel="benzin", year=2020, power_hp=340, cc=2998, seller_title="BMW 320d 190 mild hybrid"), None),
    "the class in a title is no power": (dict(make="BMW", model="840i", fuel="benzin", year=2020, power_hp=340, cc=2998, seller_title="BMW 320d"), ("designation", None)),
    "kilowatts in a title are no power": (dict(make="BMW", model="840i", fuel="benzin", year=2020, power_hp=340, cc=2998, seller_title="BMW 320d 190 kW"), ("designation", None)),
    "no fuel": (dict(fuel=None, variant="2.0 GTI 230 PS"), None),
}


@pytest.fixture(scope="module")
def resolved(spark, catalog):
    ads = spark.createDataFrame([tuple((PLAIN | change | {"ad_id": name})[n] for n in NAMES) for name, (change, _) in CASES.items()], ADS)
    read = signals.listing_signals(ads, catalog.mids)
    return {r["ad_id"]: r for r in resolver.resolve(read, catalog.versions, catalog.mids).collect()}


@pytest.mark.parametrize("name", CASES)
def test_resolved(resolved, name):
    row = resolved.get(name)
    assert (None if row is None else (row["tier"], row["version_id"])) == CASES[name][1]


def test_designation_facts(resolved):
    facts = resolved["bodies alone leave the designation"]["facts"]
    assert (facts["cc"], facts["power_hp"], facts["mid"], facts["derivative"]) == (2998, 340, None, None)


@pytest.mark.parametrize(("text", "trims"), [("Golf GTI R-Line", ["gti"]), ("S line r m n", []), ("i30 N-Performance gti GTI", ["performance", "gti"]), ("AMG-Line amg-line", []), (None, [])])
def test_trims_in_text(spark, text, trims):
    assert spark.range(1).select(signals.trims_in_text(F.lit(text).cast("string"))).first()[0] == trims


@pytest.mark.parametrize(("title", "powers"), [("GLC 220 220d 194", [194]), ("BMW 840d 340 2019", [340]), ("152 kW", []), ("59 60 900 901", [60, 900]), (None, [])])
def test_title_powers(spark, title, powers):
    assert spark.range(1).select(signals.title_powers(F.lit(title).cast("string"))).first()[0] == powers


def test_series_of_performance_models_and_badges(spark, catalog):
    ads = spark.createDataFrame([tuple((PLAIN | dict(ad_id="a", make="BMW", model="M850i xDrive 45", variant="v50"))[n] for n in NAMES)], ADS)
    row = signals.listing_signals(ads, catalog.mids).first()
    assert (row["family"], row["via_fallback"], set(row["badges"])) == ("serie-8", False, {"m850i", "xdrive45", "v50"})
