"""Pairs of places and locations that matter for the nearest units.

A place looks for the first ``need`` units of its group by L1 distance; locations
hold units.  Below DIRECT_PAIRS pairs in all, places are joined to their group's
locations.  Beyond it the locations are put in the cells of a quantile grid: slices
of about equally many locations by latitude, each cut the same way by longitude, so
that cells are small where locations are dense.  Per place the cells are taken in
rings of growing greatest distance until they surely hold ``need`` units; locations
are joined only from cells whose least distance lies within that ring.  With N
locations the grid has about sqrt(N) cells of sqrt(N) locations, and a place meets
those cells and the locations of a few of them instead of N.

The cut is exact: distances to a cell's corners are made of the same operations as
those to its locations, and rounding keeps their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.scalar import l1_distance
from cartwise.session import stored

DIRECT_PAIRS = 4_000_000
SLICES = 64                     # of a group by each coordinate at most
INFINITE = float("inf")


def _odd(c: Column) -> Column:
    """A coordinate that no distance can be told from."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == INFINITE)


def _slice(bounds: Column, value: Column, slices: Column) -> Column:
    """Which of ``slices`` parts between every (SLICES / slices)-th bound holds value."""
    step = (F.lit(SLICES) / slices).cast("int")
    below = F.filter(bounds, lambda x, i: ((i + 1) % step == 0) & (x < value))
    return F.size(below)


def grid(locations: DataFrame, group: str, lat: str, lng: str) -> DataFrame:
    """``locations`` with the row and column of their cell; -1 where a coordinate is
    missing, not a number or infinite.  Bounds come from mergeable sketches, so no
    group meets in one task for them; they need not be exact."""
    ranks = [i / SLICES for i in range(1, SLICES)]
    sketch = lambda c: F.percentile_approx(F.when(~_odd(F.col(c)), F.col(c)), ranks)
    per_group = locations.groupBy(group).agg(sketch(lat).alias("_by_lat"),
                                             F.count(F.lit(1)).alias("_n"))
    # slices a side: the fourth root of the locations, a power of two
    side = F.pow(F.lit(2.0), F.ceil(F.log2("_n") / 4)).cast("int")
    per_group = per_group.select(group, "_by_lat",
                                 F.least(side, F.lit(SLICES)).alias("_side"))
    odd = _odd(F.col(lat)) | _odd(F.col(lng))
    rows = locations.join(per_group, group).withColumn(
        "_row", F.when(odd, -1).otherwise(_slice(F.col("_by_lat"), F.col(lat), F.col("_side"))))
    per_row = rows.groupBy(group, "_row").agg(sketch(lng).alias("_by_lng"))
    return (rows.join(per_row, [group, "_row"])
            .withColumn("_col", F.when(odd, -1).otherwise(
                _slice(F.col("_by_lng"), F.col(lng), F.col("_side"))))
            .drop("_by_lat", "_by_lng", "_side"))


def _least(q: Column, low: str, high: str) -> Column:
    return F.greatest(F.col(low) - q, q - F.col(high), F.lit(0.0))


def _most(q: Column, low: str, high: str) -> Column:
    return F.greatest(F.abs(F.col(low) - q), F.abs(F.col(high) - q))


def cells_in_reach(places: DataFrame, cells: DataFrame, group: str, need: Column) -> DataFrame:
    """The cells that can hold one of a place's first ``need`` units: all within the
    least ring that surely holds as many, all of them if none does."""
    qlat, qlng = F.col("_place.lat"), F.col("_place.lng")
    blind = _odd(qlat) | _odd(qlng)
    far = _most(qlat, "_lat0", "_lat1") + _most(qlng, "_lng0", "_lng1")
    near = _least(qlat, "_lat0", "_lat1") + _least(qlng, "_lng0", "_lng1")
    odd = F.col("_row") < 0
    met = places.join(cells, group).withColumns({
        "_far": F.when(blind | odd, INFINITE).otherwise(far),
        "_near": F.when(blind, 0.0).when(odd, INFINITE).otherwise(near)})
    one = Window.partitionBy(group, "_place")
    ring = one.orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.when(F.sum("_held").over(ring) >= need, F.col("_far"))
    met = met.withColumn("_enough", enough)
    return (met.withColumn("_ring", F.coalesce(F.min("_enough").over(one), F.lit(INFINITE)))
            .where(F.col("_near") <= F.col("_ring"))
            .select(*places.columns, "_row", "_col"))


def reachable(places: DataFrame, locations: DataFrame, group: str, lat: str, lng: str,
              need: Column, most_pairs: int, units: str = "_units",
              direct_pairs: int | None = None) -> DataFrame:
    """Places (``group``, ``_place`` a struct of lat and lng, further columns that
    ``need`` reads) with the locations of their group that may hold one of the first
    ``need`` units, and their distance ``_d`` (NULL if unknown; such locations come
    last).  ``most_pairs`` bounds the pairs of all groups; beyond ``direct_pairs`` of
    them (DIRECT_PAIRS) the grid is built, on a written copy of the locations."""
    if most_pairs <= (DIRECT_PAIRS if direct_pairs is None else direct_pairs):
        pairs = places.join(locations, group)
    else:
        located = stored(grid(locations, group, lat, lng), "grid")
        cells = located.groupBy(group, "_row", "_col").agg(
            F.min(lat).alias("_lat0"), F.max(lat).alias("_lat1"), F.min(lng).alias("_lng0"),
            F.max(lng).alias("_lng1"), F.sum(units).alias("_held"))
        pairs = cells_in_reach(places, cells, group, need).join(
            located, [group, "_row", "_col"]).drop("_row", "_col")
    return pairs.withColumn("_d", l1_distance(F.col(lat), F.col(lng), F.col("_place.lat"),
                                              F.col("_place.lng")))
