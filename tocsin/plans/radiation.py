"""The radiation detector in full: stations that depart, thinned and grouped, judged by level and held to a budget of public events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.stats import MAD_SCALE, median, robust_z
from ..functions.timeutil import DAY
from ..operators.graph import components, greedy, kept
from ..operators.joins import band_join, radius_pairs

#: Days and least readings of a baseline, seconds for which a reading counts as recent and for which two are adjacent.
BASELINE_DAYS, LEAST_READINGS, RECENT, ADJACENT = 30, 48, 180 * 60, 90 * 60
#: The rise and the ratio that depart, the dose rate that departs by itself, and the one that is critical.
RISE, RATIO, OUTRIGHT, CRITICAL = 0.5, 3.0, 5.0, 10.0
#: Kilometres of copies and of groups, stations considered, seconds of the public budget.
COPY_KM, GROUP_KM, CONSIDERED, BUDGET = 1.0, 50.0, 200, 6 * 3600

ID = ["pass", "source", "station_id"]


def departs(value, med):
    return ((value >= RATIO * med) & (value - med >= RISE)) | (value >= OUTRIGHT)


def departing_stations(readings: DataFrame, passes: DataFrame, order: list[str]) -> DataFrame:
    """pass, source, station_id, t, value, med, z, ratio, hours, since of the stations that depart at each pass (passes: pass).

    readings: source, station_id, t, value (not negative), normal, and what else `order` names. A station's newest reading must be recent
    and normal, and its month before it hold enough normal ones. `hours` counts the adjacent departing readings that end in the newest,
    `since` is the first's time. A rate under RISE can't depart whatever the median, so that few rows meet their past at all.
    """
    r = readings.select("source", "station_id", *order, "value", "normal")
    near = band_join(passes.select("pass"), r, "pass", "t", RECENT, 0)
    last = near.groupBy(*ID).agg(F.max(F.struct(*order, "value", "normal")).alias("last")).filter(F.col("last.normal") & (F.col("last.value") >= RISE))
    past = r.select("source", "station_id", F.struct(*order).alias("o"), F.col("t").alias("past_t"), F.col("value").alias("x"), F.col("normal").alias("x_normal"))
    own = last.withColumn("last_o", F.struct(*[F.col(f"last.{c}").alias(c) for c in order]))
    history = band_join(own, past, "pass", "past_t", BASELINE_DAYS * DAY, 0, ["source", "station_id"]).filter(F.col("o") <= F.col("last_o"))
    # a station's month at a pass is one row from here on, the newest first
    h = F.sort_array(F.collect_list(F.struct("o", "x", "x_normal")), False)
    months = history.groupBy(*ID).agg(F.first("last").alias("last"), F.first("last_o").alias("last_o"), h.alias("h"))
    usual = months.withColumn("xs", F.array_sort(F.transform(F.filter("h", lambda e: e.x_normal & e.x.isNotNull() & (e.o != F.col("last_o"))), lambda e: e.x)))
    base = usual.filter(F.size("xs") >= LEAST_READINGS).withColumn("med", middle("xs"))
    base = base.withColumn("far", F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("med"))))).withColumn("mad", middle("far") * MAD_SCALE)
    out = base.select(*ID, F.col("last.t").alias("t"), F.col("last.value").alias("value"), "med", "mad", "h", "last_o")
    out = out.filter(departs(F.col("value"), F.col("med")))
    z = robust_z("value", "med", "mad", F.greatest(F.lit(0.02), 0.05 * F.col("med")))
    out = out.withColumn("z", z).withColumn("ratio", F.when(F.col("med") > 0, F.col("value") / F.col("med")))
    near_next = lambda e, i: F.get("h", i - 1).o.t - e.o.t <= ADJACENT
    breaks = F.transform("h", lambda e, i: ~((e.o == F.col("last_o")) | (e.x_normal & departs(e.x, F.col("med")) & F.coalesce(near_next(e, i), F.lit(True)))))
    out = out.withColumn("hours", F.coalesce(F.nullif(F.array_position(breaks, True), F.lit(0)) - 1, F.size("h")).cast("long"))
    return out.select(*ID, "t", "value", "med", "z", "ratio", "hours", F.get("h", F.col("hours").cast("int") - 1).o.t.alias("since"))


def middle(values: str):
    """The median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def thinned(stations: DataFrame, considered: int = CONSIDERED) -> DataFrame:
    """stations (ID, value, lat, lon) without copies: in the order of value, each is kept unless one kept before has its number or stands
    within COPY_KM; of those the first `considered` of a pass, as the detector defines it."""
    s = stations.withColumn("id", F.struct(*ID))
    close = radius_pairs(s, "id", COPY_KM, keys=["pass"]).filter(F.col("km") < COPY_KM).select("a", "b")
    same = s.select("pass", "station_id", F.col("id").alias("a")).join(s.select("pass", "station_id", F.col("id").alias("b")), ["pass", "station_id"]).filter("a < b").select("a", "b")
    order = F.struct((-F.col("value")).alias("v"), F.col("station_id").alias("k"), F.col("source").alias("s"))
    chosen = greedy(s.select("id", order.alias("o")), close.union(same).distinct())
    rank = F.row_number().over(Window.partitionBy("pass").orderBy(order))
    return s.join(chosen, "id", "left_semi").withColumn("_rank", rank).filter(F.col("_rank") <= considered).drop("_rank")


def judged(members: DataFrame, sparse: list[str]) -> DataFrame:
    """A row for each pass and group of members no farther apart than GROUP_KM: event_key, level, n, lat, lon, nearest, top, ratio, rise, hours,
    observed, networks, coherent and first (its place in the pass). Networks with one monitor a city (`sparse`) are asked for a second hour
    instead of neighbours, and their events keep the first hour in their key."""
    m = kept(members)
    groups = components(radius_pairs(m, "id", GROUP_KM, keys=["pass"]).select("a", "b"), m.select("id"))
    m = m.join(groups, "id")
    by = ["pass", "component"]
    mean = lambda c: F.sum(F.round(F.col(c) * 1e7).cast("long")) / F.count("*") / 1e7  # noqa: E731  whole numbers, so that keys don't hang on the rows' order
    centre = m.groupBy(*by).agg(mean("lat").alias("c_lat"), mean("lon").alias("c_lon"))
    m = m.join(centre, by).withColumn("_km", F.round(haversine("lat", "lon", "c_lat", "c_lon"), 6))
    first = F.struct((-F.col("value")).alias("v"), F.col("station_id").alias("k"), F.col("source").alias("s"))
    g = m.groupBy(*by, "c_lat", "c_lon").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("name") != "", F.col("name"))).alias("names"), F.min_by("station_id", F.struct("_km", first)).alias("nearest"), F.max("value").alias("top"),
        F.when(F.every(F.col("ratio").isNotNull()), median("ratio")).alias("ratio"), median(F.col("value") - F.col("med")).alias("rise"), F.every(F.coalesce(F.col("z") >= 5, F.lit(False))).alias("sharp"),
        F.every(F.col("source").isin(sparse)).alias("sparse"), F.max("hours").alias("hours"), F.max("t").alias("observed"), F.min("since").alias("since"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("networks"), F.min(first).alias("first"),
    )
    strong = F.coalesce(F.col("sharp") & (F.col("ratio") >= RATIO) & (F.col("rise") >= RISE), F.lit(False))
    agreed = F.when(F.col("sparse"), (F.col("hours") >= 2) | (F.col("n") >= 2)).otherwise((F.col("n") >= 3) & (F.col("names") >= 2))
    g = g.withColumn("strong", strong).withColumn("coherent", strong & agreed)
    lone = F.when(~F.col("strong"), 1).when(~F.col("coherent"), 3).when(F.col("top") >= CRITICAL, 5).otherwise(4)
    dense = F.when(~F.col("coherent"), 1).when((F.col("top") >= CRITICAL) | (F.col("n") >= 15), 5).when(F.col("n") >= 5, 4).otherwise(3)
    hour = F.date_format(F.timestamp_seconds(F.when(F.col("sparse"), F.col("since")).otherwise(F.col("observed"))), "yyyy-MM-dd'T'HH")
    key = F.concat(F.lit("radiation:"), F.format_number("c_lat", 2), F.lit(","), F.format_number("c_lon", 2), F.lit(":"), hour)
    return g.select(
        "pass", key.alias("event_key"), F.when(F.col("sparse"), lone).otherwise(dense).cast("int").alias("level"), "n", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "nearest", "top", "ratio", "rise", "hours", "observed",
        "networks", "coherent", "first",
    )


def stretches(rows: DataFrame, time: str, reach: str) -> DataFrame:
    """rows with `stretch`, the time at which their stretch begins: a stretch ends where no row reaches the next one. Days are summed up first,
    so that the only window without a key runs over one row a day."""
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_day").orderBy(time)
    r = rows.withColumn("_day", F.floor(F.col(time) / DAY))
    d = r.groupBy("_day").agg(F.max(reach).alias("_reach")).withColumn("_reach", F.max("_reach").over(before)).select("_day", "_reach")
    known = F.greatest("_reach", F.max(reach).over(within.rangeBetween(Window.unboundedPreceding, -1)))
    r = r.join(d, "_day", "left").withColumn("_begin", F.when(known.isNull() | (F.col(time) > known), F.col(time)))
    s = r.groupBy("_day").agg(F.max("_begin").alias("_start")).withColumn("_start", F.max("_start").over(before)).select("_day", "_start")
    out = r.join(s, "_day", "left").withColumn("stretch", F.coalesce(F.max("_begin").over(within.rangeBetween(Window.unboundedPreceding, 0)), "_start"))
    return out.drop("_day", "_reach", "_begin", "_start")


def budgeted(events: DataFrame, budget: int = BUDGET) -> DataFrame:
    """events (pass, event_key, level, first) with `level` as published, `suppressed` and `public_at`: over all passes in their order, one new
    public event (level 3 or 4) in `budget` seconds; critical ones always go out and use it up, and what is public stays so.

    Passes that can't touch each other (none within the budget, no key in common) are settled apart; only events of level 3 and over,
    which are few, are looked at one by one.
    """
    loud = events.filter("level >= 3").select("pass", "event_key", "level", "first")
    reach = F.greatest(F.col("pass") + budget, F.max("pass").over(Window.partitionBy("event_key")))
    loud = stretches(loud.withColumn("reach", reach), "pass", "reach").select("stretch", "pass", "event_key", "level", "first.*")

    def settle(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["pass", "v", "k", "s"])
        public: dict[str, int] = {}
        newest, since = None, []
        for now, key, level in zip(df["pass"], df["event_key"], df["level"]):
            if key not in public and (level >= 5 or newest is None or newest < now - budget):
                public[key] = newest = now
            since.append(public.get(key))
        return df[["pass", "event_key", "v", "k", "s"]].assign(public_at=pd.array(since, dtype="Int64"))

    kinds = dict(loud.dtypes)
    settled = loud.groupBy("stretch").applyInPandas(settle, f"pass long, event_key string, v {kinds['v']}, k {kinds['k']}, s string, public_at long")
    settled = settled.select("pass", "event_key", F.struct("v", "k", "s").alias("first"), "public_at", F.lit(True).alias("loud"))
    out = events.join(settled, ["pass", "event_key", "first"], "left")
    quiet = F.col("loud").isNotNull() & F.col("public_at").isNull()
    return out.withColumn("level", F.when(quiet, 1).otherwise(F.col("level"))).withColumn("suppressed", quiet).drop("loud")


def radiation_events(stations: DataFrame, readings: DataFrame, passes: DataFrame, order: list[str], sparse: list[str]) -> DataFrame:
    """The events of all passes. stations: source, station_id, name, lat, lon."""
    found = kept(departing_stations(readings, passes, order))
    return budgeted(kept(judged(thinned(found.join(stations, ["source", "station_id"])), sparse)))
