"""How groups of aircraft behave: turns in one piece of sky and departures from one place, against the same clock hours of the days before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, centroid, haversine, tight_cell
from ..functions.stats import median
from ..functions.timeutil import DAY
from ..operators.graph import kept, radius_components
from ..operators.joins import band_join
from ..operators.sequences import hour_overlaps

#: Days looked back and those needed, kilometres of a group of turns and of departures, least turns and departures, times the median.
LOOKBACK, LEAST_DAYS, TURN_KM, ORIGIN_KM, TURNS, DEPARTURES, TIMES = 21, 10, 200.0, 60.0, 3, 6, 3.0


def grouped(events: DataFrame, instants: DataFrame, km: float, window: int) -> DataFrame:
    """instant, grp, hex, lat, lon: aircraft with an event (hex, t, lat, lon) in the `window` seconds up to each instant, the last of each, grouped
    where no farther apart than km."""
    near = band_join(instants.select("instant"), events.select("hex", "t", "lat", "lon"), "instant", "t", window - 1, 0)
    last = kept(near.groupBy("instant", "hex").agg(F.max(F.struct("t", "lat", "lon")).alias("e")).select("instant", "hex", "e.lat", "e.lon"))
    return last.join(radius_components(last, "hex", km, ["instant"]), ["instant", "hex"]).select("instant", F.col("component").alias("grp"), "hex", "lat", "lon")


def clock_hours(instants: DataFrame, covered: DataFrame, window: int) -> DataFrame:
    """instant, ago, hour, weight: the hours that the same window touched on each of the days before, and their shares of it; only days all
    of whose hours are covered (hour: whole hours since the epoch)."""
    w = instants.select("instant").withColumn("ago", F.explode(F.sequence(F.lit(1), F.lit(LOOKBACK)))).withColumn("until", F.col("instant") - F.col("ago") * DAY)
    h = hour_overlaps(w.withColumn("from", F.col("until") - window), "from", "until").select("instant", "ago", "hour", "weight")
    have = h.join(covered.select("hour", F.lit(True).alias("have")).distinct(), "hour", "left")
    whole = have.groupBy("instant", "ago").agg(F.every(F.col("have").isNotNull()).alias("whole")).filter("whole").select("instant", "ago")
    return h.join(whole, ["instant", "ago"])


def hourly(events: DataFrame) -> DataFrame:
    """hour, hex, lat, lon: each hour's aircraft, where their last event in it was."""
    h = events.withColumn("hour", F.floor(F.col("t") / 3600))
    return h.groupBy("hour", "hex").agg(F.max(F.struct("t", "lat", "lon")).alias("e")).select("hour", "hex", "e.lat", "e.lon")


def turn_clusters(turns: DataFrame, instants: DataFrame, covered: DataFrame, least: int = TURNS, window: int = 3600) -> DataFrame:
    """instant, n, median, days, level: the largest group of turns at each instant that is large enough by itself and against the hour's count
    on the days before."""
    size = grouped(turns, instants, TURN_KM, window).groupBy("instant", "grp").agg(F.count("*").alias("n")).groupBy("instant").agg(F.max("n").alias("n")).filter(F.col("n") >= least)
    size = kept(size)
    count = hourly(turns).groupBy("hour").agg(F.count("*").alias("k"))
    past = clock_hours(size, covered, window).join(count, "hour", "left").groupBy("instant", "ago").agg(F.sum(F.coalesce("k", F.lit(0)) * F.col("weight")).alias("x"))
    base = past.groupBy("instant").agg(F.count("*").alias("days"), median("x").alias("median")).filter(F.col("days") >= LEAST_DAYS)
    out = size.join(base, "instant").filter(F.col("n") >= TIMES * F.col("median"))
    return out.select("instant", "n", "median", "days", F.when(F.col("n") >= 2 * least, 4).otherwise(3).alias("level"))


def origin_clusters(departures: DataFrame, instants: DataFrame, covered: DataFrame, window: int = 3600) -> DataFrame:
    """instant, event_key, level, n, median, days, lat, lon, hexes (sorted) of places from which unusually many aircraft depart.

    A group's footprint is fixed: on the days before, departures count that were within ORIGIN_KM of one of its members, so that they can't
    chain outward. Those in a `tight_cell` that has a member are counted by cell; only the places around are held against members, by
    latitude band and once an instant. Keys are those of `episodes`.
    """
    m = grouped(departures, instants, ORIGIN_KM, window)
    by, cell = ["instant", "grp"], ["row", "col"]
    row, col = tight_cell("lat", "lon", ORIGIN_KM)
    size = kept(m.groupBy(*by).agg(F.count("*").alias("n"), centroid("lat", "lon")[0].alias("c_lat"), centroid("lat", "lon")[1].alias("c_lon")).filter(F.col("n") >= DEPARTURES))
    hours = kept(clock_hours(size.select("instant").distinct(), covered, window))
    each = hours.select("instant", "hour").distinct()
    step = ORIGIN_KM / (EARTH_KM * 3.141592653589793 / 180)
    band = lambda c: F.floor(F.col(c) / step)
    feet = kept(m.join(size.select(*by), by).select(*by, F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), row.alias("row"), col.alias("col")).distinct())
    inside = feet.select(*by, *cell).distinct()
    past = kept(hourly(departures).groupBy("hour", "lat", "lon").agg(F.count("*").alias("k")).withColumn("row", row).withColumn("col", col))
    sure = inside.join(each, "instant").join(past.groupBy("hour", *cell).agg(F.sum("k").alias("k")), ["hour", *cell]).select(*by, "hour", "k")
    sites = each.join(past, "hour").select("instant", "lat", "lon", *cell, band("lat").alias("band")).distinct()
    reach = feet.withColumn("band", F.explode(F.array(*[band("m_lat") + d for d in (-1, 0, 1)])))
    around = sites.join(reach.select(*by, "band").distinct(), ["instant", "band"]).join(inside, [*by, *cell], "left_anti")
    around = around.join(reach.select(*by, "band", "m_lat", "m_lon"), [*by, "band"]).filter(haversine("lat", "lon", "m_lat", "m_lon") <= ORIGIN_KM).select(*by, "lat", "lon").distinct()
    rest = around.join(each, "instant").join(past.select("hour", "lat", "lon", "k"), ["hour", "lat", "lon"]).select(*by, "hour", "k")
    seen = sure.unionByName(rest).groupBy(*by, "hour").agg(F.sum("k").alias("k"))
    past = size.select(*by).join(hours, "instant").join(seen, [*by, "hour"], "left").groupBy(*by, "ago").agg(F.sum(F.coalesce("k", F.lit(0)) * F.col("weight")).alias("x"))
    base = past.groupBy(*by).agg(F.count("*").alias("days"), median("x").alias("median"))
    out = size.join(base, by).filter((F.col("days") >= LEAST_DAYS) & (F.col("median") >= 1) & (F.col("n") >= TIMES * F.col("median")))
    level = F.when(F.col("n") >= 2 * F.greatest(F.lit(float(DEPARTURES)), TIMES * F.col("median")), 4).otherwise(3)
    out = kept(out.select(*by, level.alias("level"), "n", "median", "days", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon")))
    hexes = m.select(*by, "hex").join(out.select(*by), by).groupBy(*by).agg(F.array_sort(F.collect_list("hex")).alias("hexes"))
    out = kept(out.join(hexes, by).drop("grp"))
    return out.join(episodes(out), ["instant", "hexes"])


def episodes(clusters: DataFrame) -> DataFrame:
    """instant, hexes, event_key of clusters (instant, level, hexes): an hour's clusters in their order, each under the key of the hour's first
    event that has a member in common with it, else under one of its own (the hour and its least member). An event's members are those of
    its latest cluster of no lower level. An hour's loud clusters are what one task sees."""

    def follow(df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(hexes=[list(h) for h in df["hexes"]])
        df = df.assign(first=[h[0] for h in df["hexes"]]).sort_values(["instant", "first"])
        open_: dict[str, tuple[int, set]] = {}
        keys = []
        for start, level, hexes, first in zip(df["start"], df["level"], df["hexes"], df["first"]):
            key = next((k for k, (_, known) in open_.items() if not known.isdisjoint(hexes)), f"{start}:{first}")
            if key not in open_ or open_[key][0] <= level:
                open_[key] = (level, set(hexes))
            keys.append(key)
        return df[["instant", "hexes"]].assign(event_key=keys)

    hour = F.col("instant") - F.pmod(F.col("instant"), F.lit(3600))
    start = F.date_format(F.timestamp_seconds(hour), "yyyy-MM-dd'T'HH")
    rows = clusters.select(start.alias("start"), "instant", "level", "hexes")
    kinds = dict(rows.dtypes)
    return rows.groupBy("start").applyInPandas(follow, f"instant {kinds['instant']}, hexes {kinds['hexes']}, event_key string")
