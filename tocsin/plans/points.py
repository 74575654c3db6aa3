"""Summaries of decoded points: hex (with ~ where it is no ICAO address), type, slice, t, airborne, position, altitude, speed, call sign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_icao() -> Column:
    return F.col("hex").startswith("~")


def point_summary(points: DataFrame, order: list[str]) -> DataFrame:
    """hex, type, n, first and last position, altitudes, top speed and first call sign of other addresses."""
    at = F.struct(*order)
    one = points.filter(non_icao()).groupBy("hex", "type").agg(
        F.count("*").alias("n"), F.min_by(F.struct("t", "lat", "lon"), at).alias("f"), F.max_by(F.struct("t", "lat", "lon"), at).alias("l"), F.min("alt").alias("alt_min"), F.max("alt").alias("alt_max"),
        F.max("speed").alias("speed_max"), F.min_by("callsign", F.when(F.col("callsign").isNotNull(), at)).alias("callsign"),
    )
    ends = [F.col(f"{a}.{c}").alias(f"{b}_{c}") for a, b in (("f", "first"), ("l", "last")) for c in ("t", "lat", "lon")]
    return one.select("hex", "type", "n", *ends, "alt_min", "alt_max", "speed_max", "callsign")


def peak_slices(points: DataFrame, file: str, piece: str) -> DataFrame:
    """file, objects, airborne, peak, peak_slice: different other addresses in all, in the air, and in the air in the fullest slice (the
    earliest of equals)."""
    p = points.filter(non_icao())
    all_ = p.groupBy(file).agg(F.countDistinct("hex").alias("objects"), F.countDistinct(F.when(F.col("airborne"), F.col("hex"))).alias("airborne"))
    each = p.groupBy(file, piece).agg(F.countDistinct(F.when(F.col("airborne"), F.col("hex"))).alias("k"))
    best = each.groupBy(file).agg(F.min(F.struct((-F.col("k")).alias("d"), F.col(piece).alias("at"))).alias("b"))
    return all_.join(best, file).select(file, "objects", "airborne", (-F.col("b.d")).alias("peak"), F.col("b.at").alias("peak_slice"))


def latest_points(points: DataFrame, order: list[str], by: str) -> DataFrame:
    """hex, t, airborne, lat, lon of each other address, its last point in the air if it has one; total: all addresses of its group `by`."""
    last = points.filter(non_icao()).groupBy(by, "hex").agg(F.max_by(F.struct("t", "airborne", "lat", "lon"), F.struct("airborne", *order)).alias("p"))
    total = points.groupBy(by).agg(F.countDistinct("hex").alias("total"))
    return last.join(total, by).select(by, "hex", "p.*", "total")
