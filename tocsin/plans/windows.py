"""Do known events show? Each event's window against control windows whole weeks away, and the place that stands out against the event's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_MI, haversine
from ..functions.timeutil import HALF_HOUR

#: Weeks between an event's window and its controls, controls kept, miles of full credit and of none.
OFFSETS, CONTROLS, NEAR_MI, FAR_MI = (-12, -10, -8, -6, -4, 4, 6, 8, 10, 12), 4, 100.0, 350.0


def shifted(windows: DataFrame) -> DataFrame:
    """key, week, start, end (seconds) of each window (key, local_start, local_end, tz) and its controls; weeks are counted on the local clock,
    so that a change of summer time moves no window. Week 0 is the window itself."""
    w = windows.select("key", "local_start", "local_end", "tz", F.explode(F.array(*[F.lit(k) for k in (0, *OFFSETS)])).alias("week"))
    begin = F.col("local_start") + F.make_dt_interval(F.col("week") * 7)
    end = begin + (F.col("local_end") - F.col("local_start"))
    return w.select("key", "week", *[F.unix_timestamp(F.to_utc_timestamp(x, F.col("tz"))).alias(name) for x, name in ((begin, "start"), (end, "end"))])


def slots_of(windows: DataFrame, step: int) -> DataFrame:
    """key, week, slot: the slots that begin in [start, end)."""
    first = F.ceil(F.col("start") / step) * step
    return windows.filter(first < F.col("end")).select("key", "week", F.explode(F.sequence(first, F.col("end") - 1, F.lit(step).cast("long"))).alias("slot"))


def window_scores(windows: DataFrame, residuals: DataFrame, step: int = HALF_HOUR) -> DataFrame:
    """key, week, samples, total, positive, absolute, peak of the residuals (slot, residual) in each window; windows without any have no row."""
    j = slots_of(windows, step).join(residuals.select("slot", F.col("residual").cast("double").alias("x")), "slot")
    return j.groupBy("key", "week").agg(F.count("*").alias("samples"), F.sum("x").alias("total"), F.sum(F.greatest("x", F.lit(0.0))).alias("positive"), F.sum(F.abs("x")).alias("absolute"), F.max("x").alias("peak"))


def controls(scores: DataFrame, count: int = CONTROLS) -> DataFrame:
    """The calmest `count` controls of each key: least |total|, then least absolute, then earliest week."""
    w = Window.partitionBy("key").orderBy(F.abs("total"), "absolute", "week")
    return scores.filter("week <> 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count)


def standing(scores: DataFrame) -> DataFrame:
    """key, total, place, of: where the event's own total stands among all its windows, 1 being the largest."""
    w = Window.partitionBy("key")
    r = scores.withColumn("place", F.rank().over(w.orderBy(F.desc("total")))).withColumn("of", F.count("*").over(w))
    return r.filter("week = 0").select("key", "samples", "total", "peak", "place", "of")


def signal(windows: DataFrame, chosen: DataFrame, presence: DataFrame, step: int = HALF_HOUR) -> DataFrame:
    """key, cell, share: the cell whose count in the event's window (presence: cell, slot, n) exceeds its mean over the chosen controls most,
    and its share of all excess; the least cell of equals."""
    kept = windows.join(chosen.select("key", "week").union(windows.filter("week = 0").select("key", "week")), ["key", "week"], "left_semi")
    n = slots_of(kept, step).join(presence, "slot").groupBy("key", "cell").agg(F.sum(F.when(F.col("week") == 0, F.col("n"))).alias("now"), F.sum(F.when(F.col("week") != 0, F.col("n"))).alias("then"))
    k = chosen.groupBy("key").agg(F.count("*").alias("k"))
    d = n.join(k, "key").withColumn("delta", F.coalesce("now", F.lit(0)) - F.coalesce("then", F.lit(0)) / F.col("k")).filter("delta > 0")
    return d.groupBy("key").agg(F.min_by("cell", F.struct((-F.round("delta", 9)).alias("d"), "cell")).alias("cell"), (F.max("delta") / F.sum("delta")).alias("share"))


def match_score(miles) -> Column:
    """1 up to NEAR_MI, 0 from FAR_MI on, null without a distance."""
    return F.when(miles.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (FAR_MI - miles) / (FAR_MI - NEAR_MI))))


def signal_label(match, share) -> Column:
    """What the share of the strongest place and its match with the event's say; events without a place are judged by the share alone."""
    nowhere = F.when(share >= 0.25, "one gateway").when(share >= 0.14, "a region of gateways").otherwise("no gateway")
    placed = F.when((match >= 0.75) & (share >= 0.18), "strong match").when((match >= 0.45) & (share >= 0.14), "regional match").when(share >= 0.20, "elsewhere").otherwise("weak")
    return F.when(match.isNull(), nowhere).otherwise(placed)


def validated(windows: DataFrame, places: DataFrame, residuals: DataFrame, presence: DataFrame, cells: DataFrame, step: int = HALF_HOUR, count: int = CONTROLS) -> DataFrame:
    """A row for each event that has residuals in its window: its standing, the strongest cell and share, miles, match and label.

    windows: key, local_start, local_end, tz; places: key, lat, lon (null where unknown); cells: cell, cell_lat, cell_lon. Events without a
    control have no cell.
    """
    w = shifted(windows)
    scores = window_scores(w, residuals, step)
    chosen = controls(scores, count)
    out = standing(scores).join(signal(w, chosen, presence, step), "key", "left").join(places, "key", "left").join(cells, "cell", "left")
    out = out.withColumn("miles", haversine("lat", "lon", "cell_lat", "cell_lon", EARTH_MI)).withColumn("match", match_score(F.col("miles")))
    return out.withColumn("label", signal_label(F.col("match"), F.coalesce("share", F.lit(0.0))))
