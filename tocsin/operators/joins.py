"""Joins on time and place. Inequalities become equi joins on buckets, so that no plan needs a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, before: int, after: int, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs with left_time - before <= right_time <= left_time + after, of equal keys.

    Columns of the two sides must differ, but for the keys. Right rows fall into buckets of the band's width; left rows go
    to the two or three buckets that the band can touch.
    """
    keys = keys or []
    width = max(1, before + after)
    bucket = lambda t: F.floor(t / width)
    r = right.withColumn("_bucket", bucket(F.col(right_time)))
    lo, hi = bucket(F.col(left_time) - before), bucket(F.col(left_time) + after)
    inside = (F.col(right_time) >= F.col(left_time) - before) & (F.col(right_time) <= F.col(left_time) + after)
    if how == "inner":
        return left.withColumn("_bucket", F.explode(F.sequence(lo, hi))).join(r, [*keys, "_bucket"]).filter(inside).drop("_bucket")
    if how not in ("left_semi", "left_anti"):
        raise ValueError("inner, left_semi or left_anti")
    ids = left.withColumn("_row", F.monotonically_increasing_id())
    found = ids.select(*keys, left_time, "_row").withColumn("_bucket", F.explode(F.sequence(lo, hi))).join(r, [*keys, "_bucket"]).filter(inside).select("_row").distinct()
    return ids.join(found, "_row", how).drop("_row")


#: Fixed value: rows of a partition where many are sorted.
ROWS = 500_000


def parts(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def dealt(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int) -> DataFrame:
    """The join of left and right (tables of so many rows in all) on their keys, in so many partitions that one holds about ROWS of them.
    Adaptive plans merge partitions by their packed bytes, and what a task sorts then grows with the input."""
    n = parts(left.sparkSession, rows)
    return left.repartition(n, left_key).join(right.repartition(n, right_key), F.col(left_key) == F.col(right_key))


def asof_backward(rows: DataFrame, key: str, time: str, order: list[str], value: str, least_gap: int, name: str = "previous") -> DataFrame:
    """rows with `name`: value and time of the key's latest row at least least_gap seconds earlier; one window, no self join."""
    w = Window.partitionBy(key).orderBy(F.col(time)).rangeBetween(Window.unboundedPreceding, -least_gap)
    latest = F.max(F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.col(value).alias("v"))).over(w)
    return rows.withColumn(name, latest)


def asof_nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, within: int, left_id: str, keys: list[str] | None = None) -> DataFrame:
    """left (its id unique) with the nearest right row in reach, the earlier on ties; rows without one are dropped."""
    pairs = band_join(left, right, left_time, right_time, within, within, keys)
    values = [c for c in right.columns if c not in (keys or [])]
    best = pairs.groupBy(left_id).agg(F.min_by(F.struct(*values), F.struct(F.abs(F.col(left_time) - F.col(right_time)), F.col(right_time))).alias("_near"))
    return left.join(best, left_id).select(*left.columns, *[F.col(f"_near.{c}").alias(c) for c in values])



def radius_pairs(points: DataFrame, key: str, km: float, lat: str = "lat", lon: str = "lon", keys: list[str] | None = None) -> DataFrame:
    """a < b and km of all pairs of points (of equal keys) no farther apart: points meet in latitude bands and their neighbours, and there in
    longitude cells as wide as the radius at the band's farthest latitude."""
    step, keys = km / (EARTH_KM * 3.141592653589793 / 180), keys or []
    band = F.floor(F.col(lat) / step).cast("long")
    p = points.select(*keys, F.col(key).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), band.alias("band"))
    left = p.select(*keys, F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("band").alias("own"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    # a pair in bands i and j is joined in band j with cells of the band (of i and j) nearer a pole
    widest = lambda a, b: F.greatest(F.abs(F.least(a, b) * step), F.abs((F.greatest(a, b) + 1) * step))
    share = lambda far: F.greatest(F.cos(F.radians(F.least(far + step, F.lit(90.0)))), F.lit(1e-9))
    n_cells = lambda far: F.greatest(F.floor(360 / (step / share(far))), F.lit(1)).cast("long")
    right = p.select(*keys, F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("own"))
    count = n_cells(widest(F.col("own"), F.col("band")))
    cell = lambda x: F.least(F.floor((x + 180) / 360 * F.col("cells")), F.col("cells") - 1).cast("long")
    left = left.withColumn("cells", count).withColumn("cell", cell(F.col("lon_a")))
    right = right.withColumn("cells", count).withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("lon_b")) + d, F.col("cells"))))))
    pairs = left.join(right, [*keys, "own", "band", "cells", "cell"]).filter("a < b")
    return pairs.withColumn("km", haversine("lat_a", "lon_a", "lat_b", "lon_b")).filter(F.col("km") <= km).select("a", "b", "km")


def nearest_in_radius(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, km: float, radius: str | None = None) -> DataFrame:
    """point_id, site_id and km of the nearest site in reach; sites (site_id, site_lat, site_lon) are a dimension. A site's own radius, km
    at most, may stand in a column.

    Sites meet points in latitude bands as high as the radius; ties go to the smallest site.
    """
    step = km / (EARTH_KM * 3.141592653589793 / 180)
    s = sites.withColumn("_band", F.explode(F.array(*[F.floor(F.col("site_lat") / step) + d for d in (-1, 0, 1)])))
    near = points.withColumn("_band", F.floor(F.col("lat") / step)).join(s, "_band").withColumn("km", haversine("lat", "lon", "site_lat", "site_lon")).filter(F.col("km") <= (F.col(radius) if radius else km))
    return near.groupBy(point_id).agg(F.min(F.struct("km", site_id)).alias("n")).select(point_id, f"n.{site_id}", "n.km")
