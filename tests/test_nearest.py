"""The grid search for the nearest units against all pairs of places and locations."""
from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import nearest
from cartwise.plans import recommend as rec

LOCS = "product_id string, lat double, lng double, _units long"
PLACES = "product_id string, _place struct<lat:double,lng:double>, _extra long"
NAN, INF = float("nan"), float("inf")


def tables(seed: int, n: int = 400):
    r = random.Random(seed)
    spot = [(r.gauss(0, 30), r.gauss(0, 30)) for _ in range(6)]

    def point():
        kind = r.random()
        if kind < 0.03:
            return r.choice([(None, None), (None, 1.0), (1.0, None), (NAN, 2.0), (INF, 3.0),
                             (3.0, -INF)])
        if kind < 0.2:
            return float(r.randrange(-3, 4)), float(r.randrange(-3, 4))     # ties
        x, y = r.choice(spot)
        return x + r.gauss(0, 0.5), y + r.gauss(0, 0.5)

    locs = {(p, *map(str, xy)): (p, *xy, r.randint(1, 4))
            for p in ("hot", "hot", "hot", "small", "one") for xy in (point() for _ in range(
                n if p == "hot" else 9 if p == "small" else 1))}
    places = {(p, *map(str, xy)): (p, xy, r.randint(0, 3))
              for p in ("hot", "small", "one", "none") for xy in (point() for _ in range(60))}
    return list(locs.values()), list(places.values())


def first_units(pairs, need):
    """Per place: the locations reached before ``need`` units are, from joined rows."""
    by = {}
    for r in pairs:
        by.setdefault((r.product_id, str(r._place)), []).append(r)
    out = set()
    rank = lambda r: (r._d is None, r._d != r._d, r._d if r._d == r._d else 0)
    for k, rows in by.items():
        before = 0
        for d, same in itertools.groupby(sorted(rows, key=lambda r: (rank(r)[:2], rank(r)[2] or 0)),
                                         key=rank):
            if before >= need + rows[0]._extra:
                break
            same = list(same)
            out |= {(*k, str(r.lat), str(r.lng), str(r._d), r._units) for r in same}
            before += sum(r._units for r in same)
    return out


@pytest.mark.parametrize("seed,need", [(1, 1), (2, 5), (3, 40), (4, 10_000)])
def test_grid_equals_all_pairs(spark, seed, need):
    """Ties, clusters, missing, infinite and not-a-number coordinates, small groups."""
    locs, places = tables(seed)
    locs, places = spark.createDataFrame(locs, LOCS), spark.createDataFrame(places, PLACES)
    args = (places, locs, "product_id", "lat", "lng", need + F.col("_extra"), 10**9)
    direct = nearest.reachable(*args, direct_pairs=10**9).collect()
    cut = nearest.reachable(*args, direct_pairs=0).collect()
    assert first_units(cut, need) == first_units(direct, need)
    assert len(cut) <= len(direct)
    if need < 40:
        assert len(cut) < len(direct) / 3


def test_many_places_and_locations_of_one_product(spark, monkeypatch):
    """20,000 places and 20,000 locations: far below 4e8 joined rows."""
    n = 20_000
    at = lambda salt, k: F.pmod(F.xxhash64(F.col("id"), F.lit(salt + k)), F.lit(10**6)) / 1e4
    locs = spark.range(n).select(F.lit("p").alias("product_id"), at(1, 0).alias("lat"),
                                 at(2, 0).alias("lng"), F.lit(1).cast("long").alias("_units"))
    places = spark.range(n).select(
        F.lit("p").alias("product_id"), F.struct(at(3, 0).alias("lat"), at(4, 0).alias("lng"))
        .alias("_place"), F.lit(1).cast("long").alias("_extra"))
    located = nearest.grid(locs, "product_id", "lat", "lng").persist()
    sizes = located.groupBy("_row", "_col").count()
    cells, most = sizes.agg(F.count("*"), F.max("count")).first()
    assert 200 <= cells <= 300 and most < 400
    cut = nearest.reachable(places, locs, "product_id", "lat", "lng", 5 + F.col("_extra"),
                            n * n)
    assert n * cells + cut.count() < 4e8 / 15
    # the first units of some places against all locations
    some = places.where("_place.lat < 0.15")
    args = ("product_id", "lat", "lng", 5 + F.col("_extra"), n * n)
    few = nearest.reachable(some, locs, *args).collect()
    assert first_units(few, 5) == first_units(
        nearest.reachable(some, locs, *args, direct_pairs=n * n).collect(), 5)
    located.unpersist()


def test_recommendation_by_grid_equals_direct(spark, monkeypatch):
    from test_rewrites import SCHEMA, ZIPS, random_rows

    r = random.Random(5)
    df = spark.createDataFrame([x for s in range(4) for x in random_rows(s, 80)], SCHEMA)
    preds = spark.createDataFrame(
        [(f"c{i}", r.choice(["k0", "k1"]), *r.choice([*ZIPS, (None, 1.0), (2.0, None)]))
         for i in range(6)], "customer_unique_id string, predicted_category string, "
                             "pred_lat double, pred_lng double")
    got = []
    for pairs in (10**9, -1):
        monkeypatch.setattr(nearest, "DIRECT_PAIRS", pairs)
        got.append(sorted(map(str, rec.recommend(df, preds, 3, 4, seed=1).collect())))
    assert got[0] == got[1] and got[0]
