"""Tracks of moving objects: takeoffs, landings and turnarounds told from fixes (hex, t, lat, lon, alt_ft, gs_kt, ground)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_NM, bearing, bearing_change, haversine
from ..operators.sequences import by, cooldown

#: Gap between segments, confirmation window, cooldown and shortest ground run without a ground flag, in seconds.
GAP, CONFIRM, COOLDOWN, GROUND_RUN = 45 * 60, 30 * 60, 8 * 60, 30
#: Climb or descent in feet and distance in nautical miles; a lower climb that counts when far and fast (knots); a landing's distance.
CLIMB, NEAR_NM, LOW_CLIMB, FAR_NM, FAST, LANDING_NM = 1000, 1.5, 500, 8, 120, 1.0
#: Speeds of ground and air in knots, low altitude in feet and low speed, airborne fixes that confirm, fixes of a segment.
GROUND_KT, AIR_KT, LOW_FT, LOW_KT, LEAST_AIR, LEAST_FIXES = 45, 60, 12000, 250, 3, 3
FIX = ("t", "lat", "lon", "alt_ft", "gs_kt", "ground")


def known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def is_ground() -> Column:
    slow = known("gs_kt") & (F.col("gs_kt") <= GROUND_KT)
    return F.coalesce(F.col("ground"), F.lit(False)) | (slow & (~known("alt_ft") | (F.col("alt_ft") <= LOW_FT)))


def is_air() -> Column:
    return known("alt_ft") & ~is_ground() & (~known("gs_kt") | (F.col("gs_kt") >= AIR_KT))


def is_low(alt: Column, gs: Column) -> Column:
    """Of an airborne fix."""
    return (alt <= LOW_FT) | F.coalesce(gs <= LOW_KT, F.lit(False))


def segments(fixes: DataFrame) -> DataFrame:
    """fixes once each, in (hex, segment): a new segment begins after a longer gap. air is null where a fix tells neither."""
    f = fixes.withColumn("ground", F.coalesce("ground", F.lit(False)))
    for c in ("alt_ft", "gs_kt"):
        f = f.withColumn(c, F.when(known(c), F.col(c)))
    order = by("hex", ["t", "lat", "lon", "alt_ft", "gs_kt", "ground"])
    same = F.struct(F.round("t").alias("t"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "alt_ft", "ground")
    f = f.withColumn("_same", same.eqNullSafe(F.lag(same).over(order))).filter("not _same").drop("_same")
    new = F.coalesce(F.col("t") - F.lag("t").over(order) > GAP, F.lit(True)).cast("long")
    f = f.withColumn("_new", new).withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return f.select("hex", "segment", *FIX, F.when(is_ground(), False).when(is_air(), True).alias("air"))


def phase_runs(rows: DataFrame) -> DataFrame:
    """hex, segment, run, air, first and last (fixes), flagged (whether any has a ground flag), of runs of fixes on the ground or in the air;
    fixes that tell neither break no run."""
    order = by(["hex", "segment"], list(FIX))
    k = rows.filter(F.col("air").isNotNull()).withColumn("_new", F.coalesce((F.col("air") != F.lag("air").over(order)), F.lit(True)).cast("long"))
    k = k.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fix = F.struct(*FIX)
    return k.groupBy("hex", "segment", "run", "air").agg(F.min(fix).alias("first"), F.max(fix).alias("last"), F.bool_or("ground").alias("flagged"))


def candidates(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """hex, segment, kind, rule and at (the fix) of turns between ground and air, and of segments that begin or end low in the air, unless the
    neighbouring segment says that the object was lost and found in flight."""
    low = lambda c: is_low(F.col(f"{c}.alt_ft"), F.col(f"{c}.gs_kt"))
    ends = runs.filter("air").groupBy("hex", "segment").agg(F.min("first").alias("up"), F.max("last").alias("down"))
    size = rows.groupBy("hex", "segment").agg(F.count("*").alias("n"))
    w = by("hex", "segment")
    s = size.join(ends, ["hex", "segment"], "left").withColumn("low_up", low("up")).withColumn("low_down", low("down"))
    lost = lambda x, y: F.coalesce(~x & y, F.lit(False))
    s = s.withColumn("found", lost(F.lag("low_down").over(w), F.col("low_up"))).withColumn("lost", F.coalesce(F.col("low_down") & ~F.lead("low_up").over(w), F.lit(False)))
    s = s.filter(F.col("n") >= LEAST_FIXES).select("hex", "segment", "found", "lost", "low_up", "low_down")
    w = by(["hex", "segment"], "run")
    durable = lambda x: F.col(f"{x}flagged") | (F.col(f"{x}last.t") - F.col(f"{x}first.t") >= GROUND_RUN)
    r = runs.join(s, ["hex", "segment"])
    r = r.withColumn("before", F.lag(F.struct("air", "first", "last", "flagged")).over(w)).withColumn("end", F.lead("run").over(w).isNull())
    turn = F.when(F.col("air") & (F.col("run") == 1) & F.col("low_up") & ~F.col("found"), F.struct(F.lit("takeoff").alias("kind"), F.lit("start").alias("rule"), F.col("first").alias("at")))
    up = F.when(F.col("air") & ~F.col("before.air") & durable("before."), F.struct(F.lit("takeoff").alias("kind"), F.lit("turn").alias("rule"), F.col("before.last").alias("at")))
    down = F.when(~F.col("air") & F.col("before.air") & durable(""), F.struct(F.lit("landing").alias("kind"), F.lit("turn").alias("rule"), F.col("first").alias("at")))
    out = F.when(F.col("air") & F.col("end") & F.col("low_down") & ~F.col("lost"), F.struct(F.lit("landing").alias("kind"), F.lit("end").alias("rule"), F.col("last").alias("at")))
    return r.select("hex", "segment", F.explode(F.array_compact(F.array(turn, up, down, out))).alias("c")).select("hex", "segment", "c.*")


def flights(fixes: DataFrame) -> DataFrame:
    """hex, t, kind (takeoff or landing) and rule (turn, or start and end of a segment, inferred) of each object.

    An event is confirmed by the airborne fixes of its segment within the window after it (before it for a landing), three at least: climb
    and distance, or for takeoffs less climb but far and fast, or for landings with a ground flag distance alone. Events and fixes
    meet by object, segment and window's width; of one kind, events within the cooldown of the last one kept go. All steps are windows
    and joins, which spill; no object's fixes stand in one frame.
    """
    rows = segments(fixes)
    slot = F.floor(F.col("t") / CONFIRM)
    c = candidates(rows, phase_runs(rows)).withColumn("slot", F.floor(F.col("at.t") / CONFIRM))
    c = c.withColumn("slot", F.explode(F.when(F.col("kind") == "takeoff", F.array("slot", F.col("slot") + 1)).otherwise(F.array(F.col("slot") - 1, F.col("slot")))))
    up = rows.filter("air").select("hex", "segment", slot.alias("slot"), F.col("t").alias("ft"), F.col("lat").alias("flat"), F.col("lon").alias("flon"), F.col("alt_ft").alias("falt"), F.col("gs_kt").alias("fgs"))
    after = (F.col("kind") == "takeoff") & F.col("ft").between(F.col("at.t"), F.col("at.t") + CONFIRM)
    ahead = (F.col("kind") == "landing") & F.col("ft").between(F.col("at.t") - CONFIRM, F.col("at.t"))
    met = c.join(up, ["hex", "segment", "slot"]).filter(after | ahead)
    seen = met.groupBy("hex", "kind", "rule", "at").agg(
        F.count("*").alias("n"), F.max("falt").alias("top"), F.min("falt").alias("bottom"), F.max(haversine("at.lat", "at.lon", "flat", "flon", EARTH_NM)).alias("far"), F.max(F.coalesce("fgs", F.lit(0.0))).alias("fast")
    )
    takeoff = F.col("kind") == "takeoff"
    own = F.when((F.col("rule") == "end") & (F.col("at.alt_ft") == 0), None).otherwise(F.col("at.alt_ft"))
    change, far = F.col("top") - F.coalesce(own, "bottom"), F.col("far")
    sure = (change >= CLIMB) & (far >= NEAR_NM)
    sure = sure | (takeoff & (change >= LOW_CLIMB) & (far >= FAR_NM) & (F.col("fast") >= FAST)) | (~takeoff & F.col("at.ground") & (far >= LANDING_NM))
    return cooldown(seen.filter((F.col("n") >= LEAST_AIR) & sure).select("hex", F.col("at.t").alias("t"), "kind", "rule"), ["hex", "kind"], "t", COOLDOWN)


def turnarounds(fixes: DataFrame, minutes: int = 30, least_km: float = 37.04, alt_ft: float = 10000, degrees: float = 120) -> DataFrame:
    """hex, t, change of the middle of three fixes, close in time, high and far enough apart, where the course turns by so much."""
    w = by("hex", "t")
    f = fixes.select("*", *[F.lag(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("t", "lat", "lon", "alt_ft")])
    f = f.withColumn("change", bearing_change(bearing("lat2", "lon2", "lat1", "lon1"), bearing("lat1", "lon1", "lat", "lon")))
    near = (F.col("t") - F.col("t1") <= minutes * 60) & (F.col("t1") - F.col("t2") <= minutes * 60)
    high = (F.col("alt_ft") >= alt_ft) & (F.col("alt_ft1") >= alt_ft) & (F.col("alt_ft2") >= alt_ft)
    far = (haversine("lat2", "lon2", "lat1", "lon1") >= least_km) & (haversine("lat1", "lon1", "lat", "lon") >= least_km)
    return f.filter(near & high & far & (F.col("change") >= degrees)).select("hex", F.col("t1").alias("t"), F.round("change", 6).alias("change"))
