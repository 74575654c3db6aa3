"""Seasonal baselines of a count series: week slots, decayed slots, holidays, prior years; signals and their calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import clamp, decayed_mean, half_life_weight, median, robust_by
from ..functions.timeutil import day_of, nearest_holiday, slot_of_day, week_slot

#: Samples from which a baseline counts as ready: one week of slots.
READY = 336


def weekslot_baseline(slots: DataFrame) -> DataFrame:
    """week_slot, n, med, mad of (slot, n)."""
    return robust_by(slots.select(week_slot("slot").alias("week_slot"), F.col("n").cast("double").alias("x")), ["week_slot"], "x")


def weekslot_scores(slots: DataFrame) -> DataFrame:
    """slot, actual, expected, std, divergence, sigma and level. Until READY samples are there, actual is expected."""
    base = weekslot_baseline(slots).select("week_slot", "med", "mad")
    total = slots.agg(F.count("*").alias("_total"))
    s = slots.select("slot", F.col("n").cast("double").alias("actual")).withColumn("week_slot", week_slot("slot"))
    s = s.join(base, "week_slot").crossJoin(F.broadcast(total))
    ready = F.col("_total") >= READY
    s = s.select("slot", "week_slot", "actual", F.when(ready, F.col("med")).otherwise(F.col("actual")).alias("expected"), F.when(ready, F.col("mad")).otherwise(0.0).alias("std"))
    s = s.withColumn("divergence", F.col("actual") - F.col("expected"))
    return signal(s.crossJoin(F.broadcast(calibration(s).filter("model = 'absolute'").drop("model"))))


def calibration(scores: DataFrame) -> DataFrame:
    """model (absolute, relative), floor, positive_scale of scores with actual, expected and std."""
    d = F.col("actual") - F.col("expected")
    r = d / F.greatest(F.col("expected"), F.lit(1.0))
    a = scores.agg(
        F.coalesce(median(F.when(d != 0, F.abs(d))), median("std"), F.lit(0.0)).alias("floor"), median(F.when(d > 0, d)).alias("up"),
        F.coalesce(median(F.abs(r)), median("std"), F.lit(0.0)).alias("r_floor"), median(F.when(r > 0, r)).alias("r_up"),
    )
    one = lambda name, f, u: a.select(F.lit(name).alias("model"), F.col(f).alias("floor"), F.coalesce(u, f).alias("positive_scale"))
    return one("absolute", "floor", "up").unionByName(one("relative", "r_floor", "r_up"))


def signal(scores: DataFrame, threshold: float = 7.0) -> DataFrame:
    """scores (divergence, std, floor, positive_scale) with sigma, and level 1 to 5 against a threshold."""
    d = F.col("divergence")
    eff = F.greatest("std", "floor")
    v = F.when(eff > 0, d / eff).otherwise(0.0)
    weight = F.when(d > 0, d / (d + F.col("positive_scale"))).otherwise(1.0)
    sigma = F.when(v > 0, v * weight).otherwise(v)
    out = scores.withColumn("sigma", sigma)
    level = F.when(F.col("sigma") >= threshold, 5).otherwise(F.least(F.lit(4), F.floor(4 * F.greatest("sigma", F.lit(0.0)) / threshold) + 1))
    return out.withColumn("level", level.cast("long")).drop("floor", "positive_scale")


def alarm_threshold(scores: DataFrame, days: int = 365, budget: int = 2) -> DataFrame:
    """threshold: over the budget-th highest daily peak of sigma, rounded up to a tenth, 4 at least; 7 with too few days."""
    last = scores.agg(F.max(day_of("slot")).alias("_last"))
    peaks = scores.crossJoin(F.broadcast(last)).filter(day_of("slot") > F.col("_last") - days).groupBy(day_of("slot").alias("day")).agg(F.max("sigma").alias("peak"))
    top = peaks.orderBy(F.desc("peak")).limit(budget).agg(F.count("*").alias("n"), F.min("peak").alias("kth"))
    return top.select(F.when(F.col("n") < budget, 7.0).otherwise(F.greatest(F.lit(4.0), F.ceil((F.col("kth") + 0.05) * 10) / 10.0)).alias("threshold"))


def decayed_slots(slots: DataFrame, half_life: float = 2.0) -> DataFrame:
    """slot_of_day, expected: half-life means over the ages in days, each slot with its two neighbours around the clock."""
    last = slots.agg(F.max(day_of("slot")).alias("_last"))
    s = slots.crossJoin(F.broadcast(last)).select(slot_of_day("slot").alias("own"), F.col("n").cast("double").alias("x"), (F.col("_last") - day_of("slot")).alias("age"))
    near = s.withColumn("slot_of_day", F.explode(F.array(*[F.pmod(F.col("own") + d, F.lit(48)) for d in (-1, 0, 1)])))
    return near.groupBy("slot_of_day").agg(F.count("*").alias("n"), decayed_mean("x", "age", half_life).alias("expected"))


def daily_counts(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def holiday_ratios(daily: DataFrame, spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday, offset, n, ratio: the mean of a day's count over its weekday's median, clamped, at each place around a holiday."""
    usual = daily.groupBy(F.dayofweek("day").alias("dow")).agg(median(F.col("n").cast("double")).alias("usual"))
    d = nearest_holiday(daily, "day", spark, first_year, last_year).filter("holiday is not null")
    d = d.join(F.broadcast(usual), F.dayofweek("day") == F.col("dow"))
    return d.groupBy("holiday", "offset").agg(F.count("*").alias("n_days"), F.avg(clamp(F.col("n") / F.greatest("usual", F.lit(1.0)), 0.25, 2.25)).alias("ratio"))


def holiday_model(entries: DataFrame) -> DataFrame:
    """holiday, occurrence, offset, slot, ratio: of entries (the same and ratio), each occurrence's ratios from earlier ones only.

    Weights fall with the distance in days and slots and with the years between; the mean is shrunk towards 1 by w / (w + 1)."""
    e = entries.select("holiday", F.col("occurrence").alias("was"), F.col("offset").alias("at"), F.col("slot").alias("s"), F.col("ratio").alias("r"))
    near = entries.drop("ratio").join(e, "holiday").filter(F.col("was") < F.col("occurrence"))
    around = F.least(F.pmod(F.col("slot") - F.col("s"), F.lit(48)), F.pmod(F.col("s") - F.col("slot"), F.lit(48)))
    w = F.exp(-0.5 * F.pow((F.col("offset") - F.col("at")) / 0.35, 2)) * F.exp(-0.5 * F.pow(around / 2, 2)) * half_life_weight(F.greatest(F.lit(0), F.col("occurrence") - F.col("was") - 1), 3.0)
    total = near.groupBy("holiday", "occurrence", "offset", "slot").agg(F.sum(w).alias("w"), F.sum(w * F.col("r")).alias("wr"))
    return total.select("holiday", "occurrence", "offset", "slot", clamp(1 + (F.col("wr") / F.col("w") - 1) * F.col("w") / (F.col("w") + 1), 0.25, 2.25).alias("ratio"))


def prior_year_ratios(daily: DataFrame) -> DataFrame:
    """day, ratio: the count of the day one year before over its weekday's median then, clamped; days without one are left out."""
    usual = daily.groupBy(F.year("day").alias("y"), F.dayofweek("day").alias("dow")).agg(median(F.col("n").cast("double")).alias("usual"))
    past = daily.join(usual, (F.year("day") == F.col("y")) & (F.dayofweek("day") == F.col("dow")))
    past = past.select(F.col("day").alias("past_day"), clamp(F.col("n") / F.greatest("usual", F.lit(1.0)), 0.25, 2.25).alias("ratio"))
    return daily.select("day", F.add_months("day", -12).alias("past_day")).join(past, "past_day").select("day", "ratio")
