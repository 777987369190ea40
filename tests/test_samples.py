"""Home samples by selection from the vehicles of a model and year, against every pair of key and observation."""

from __future__ import annotations

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorlake.operators import market

SEEN = "id string, model_id string, year int, km int, km_band int, price int, power_hp int, seller bigint, observed_at timestamp, identity bigint, family string, derivative string"
KEYS = "model_id string, year int, km_band int, power_hp int, gen_start int, gen_end int, family string, derivative string"


@pytest.fixture(scope="module")
def seen(spark):
    """Vehicles seen again with other powers, bodies and bands, at the same time too."""
    r = Random(7)
    rows = []
    for i in range(1500):
        year, km, price = r.choice([2015, 2016, 2017]), r.choice([24800, 25100, 49000, 80000]), 20000 + r.randrange(40) * 10
        identity = hash((year, round(km / 1000), price))
        rows.append((f"i{i}", "m", year, km, km // 25000, price, r.choice([90, 100, 120, None]), r.randrange(9), r.choice(["2020-01-01", "2020-01-02"]), identity, r.choice(["f", None]), r.choice(["", "cabrio", None])))
    return spark.createDataFrame(rows, SEEN.replace("timestamp", "string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def brute(key, seen, wide):
    def inside(o):
        other = None not in (key.family, key.derivative, o.family, o.derivative) and o.family == key.family and o.derivative != key.derivative
        years = (key.gen_start is None or o.year >= key.gen_start) and (key.gen_end is None or o.year <= key.gen_end)
        return o.model_id == key.model_id and abs(o.year - key.year) <= 1 and years and abs(o.km_band - key.km_band) <= 1 + wide and o.power_hp is not None and abs(o.power_hp - key.power_hp) <= max(int(key.power_hp * 0.1 + 0.5), 15) and not other

    last = {}
    for o in sorted(filter(inside, seen), key=lambda o: (o.observed_at, o.id)):
        last[o.identity] = o
    prices, kms = [o.price for o in last.values()], [o.km for o in last.values()]
    middle = lambda v, q: int(np.rint(np.quantile(v, q))) if v else None
    return (len(prices), middle(prices, 0.5), middle(prices, 0.25), middle(prices, 0.75), middle(kms, 0.5), min(prices, default=None), max(prices, default=None), len(set(prices)), len({o.seller for o in last.values()}))


def test_samples_are_those_of_all_pairs(spark, seen):
    keys = [("m", y, b, p, s, e, f, d) for y in (2014, 2016, 2019) for b in (0, 1, 5) for p in (95, 130) for s, e in ((None, None), (2016, None), (None, 2015)) for f, d in (("f", ""), ("f", "other"), ("f", None), (None, "cabrio"))]
    keys.append(("other", 2016, 1, 95, None, None, "f", ""))
    found = market.sample_statistics(spark.createDataFrame(keys, KEYS), seen)
    got = {tuple(r)[:8]: tuple(r)[8:] for r in found.collect()}
    rows = seen.collect()
    for k in spark.createDataFrame(keys, KEYS).collect():
        both = brute(k, rows, 0) + brute(k, rows, 1)
        assert got.get(tuple(k)) == (both if both[9] else None), k
    assert 0 < len(got) < len(keys)


def test_no_row_for_a_pair_of_key_and_observation(spark, seen):
    """The shuffled rows are the observations by three years, however many keys see them."""
    keys = spark.range(50).select(F.lit("m").alias("model_id"), F.lit(2016).alias("year"), F.lit(1).alias("km_band"), (F.col("id") + 90).cast("int").alias("power_hp"))
    plan = market.sample_statistics(keys, seen)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 1


def test_origin_samples_are_those_of_all_pairs(spark):
    """Against every other listing, with vehicles listed again at other kilometres and powers; no join is left."""
    r = Random(3)
    listed = [("m", r.choice(["DE", "FR"]), r.choice([2015, 2016, 2018]), r.choice([50100, 50300, 51200, 79900, None]), r.choice([90, 100, 130, None]), r.choice([20000, 20010, 21000, 30000, 0])) for _ in range(160)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(listed)], "id int, model_id string, country string, year int, km int, power_hp int, price int")
    # a listing without power isn't in its market; it had better not ask either, as it would take another one for itself
    sampled = market.origin_samples(rows.where("price > 0"), rows)
    assert "Join" not in sampled._jdf.queryExecution().optimizedPlan().toString()
    half = lambda x: int(x + 0.5)
    seen = 0
    for got in sampled.collect():
        best = {}
        for i, (_, country, year, km, power, price) in enumerate(listed):
            if None in (km, power, got.km, got.power_hp) or i == got.id or not price or country != got.country or abs(year - got.year) > 1:
                continue
            if half(got.km * 0.6) <= km <= half(got.km * 1.6) and abs(power - got.power_hp) <= max(half(got.power_hp * 0.1), 15):
                best[year, half(km / 1000), price] = price
        assert (got.origin_n, got.origin_median) == (len(best), int(np.rint(np.median(list(best.values())))) if best else None), got
        seen += bool(best)
    assert seen > 50


def test_earlier_winners_cost_offers_once(spark, small, monkeypatch):
    from motorlake.plans import listing_queries, search_queries

    want = {r["id"] for r in search_queries.offers(spark, small).where("savings_pct >= 5").collect()} - {r["id"] for r in search_queries.showcase(spark, small).where("verdict = 'compensa'").collect()}
    calls = []
    for module in (listing_queries, search_queries):
        monkeypatch.setattr(module, "offers", lambda *a, made=search_queries.offers: calls.append(a) or made(*a))
    assert {r["id"] for r in listing_queries.no_longer_winners(spark, small).collect()} == want != set()
    assert len(calls) == 1


def test_method_limit_is_set_and_taken_back(spark):
    from motorlake.session import LIMIT, limit_methods

    for limited, want in ((True, "8000"), (True, "8000"), (False, "65535"), (False, "65535")):
        limit_methods(spark, limited)
        assert spark.conf.get(LIMIT) == want
