"""The weekly baseline in full: what a week slot usually has, told from the series' dense stretch alone, holidays left out where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import median, robust_by
from ..functions.timeutil import local_week_slot, nearest_holiday
from ..operators.sequences import gap_segments
from .baseline import READY


def dense_history(rows: DataFrame, zone: str, skip_holidays: bool) -> DataFrame:
    """cohort, slot, x, week_slot of the rows (cohort, slot, n) that a baseline is learnt from: those of the cohort's longest stretch without a
    gap; of them those far from a holiday of the zone's calendar, unless none would be left."""
    seg = gap_segments(rows, "cohort", "slot").select("cohort", "segment_start", "segment_end")
    r = rows.join(seg, "cohort").filter(F.col("slot").between(F.col("segment_start"), F.col("segment_end")))
    at = F.timestamp_seconds("slot")
    r = r.select("cohort", "slot", F.col("n").cast("double").alias("x"), local_week_slot(at, F.lit(zone)).alias("week_slot"), F.to_date(F.from_utc_timestamp(at, zone)).alias("local_day"))
    if not skip_holidays:
        return r.drop("local_day")
    # the calendar has a few rows a year; its span is that of the timestamps' years
    r = nearest_holiday(r, "local_day", rows.sparkSession, 1970, 2100)
    any_left = r.groupBy("cohort").agg(F.bool_or(F.col("holiday").isNull()).alias("any_left"))
    return r.join(any_left, "cohort").filter(F.col("holiday").isNull() | ~F.col("any_left")).select("cohort", "slot", "x", "week_slot")


def weekly_expectation(rows: DataFrame, zone: str = "UTC", skip_holidays: bool = False) -> DataFrame:
    """cohort, slot, actual, usual, samples, ready, expected, std, divergence of each row (cohort, slot, n; slots are seconds).

    `usual` is the week slot's median, or the cohort's own where the slot has no sample. A row is ready when its cohort's baseline has a
    week of samples and its slot one at least; until then it is expected as it is, without a deviation.
    """
    h = dense_history(rows, zone, skip_holidays)
    slots = robust_by(h.select("cohort", "week_slot", "x"), ["cohort", "week_slot"], "x").withColumnsRenamed({"n": "samples"})
    whole = h.groupBy("cohort").agg(F.count("*").alias("_all"), median("x").alias("_med"))
    r = rows.select("cohort", "slot", F.col("n").cast("double").alias("actual"), local_week_slot(F.timestamp_seconds("slot"), F.lit(zone)).alias("week_slot"))
    r = r.join(slots, ["cohort", "week_slot"], "left").join(whole, "cohort", "left")
    r = r.withColumn("samples", F.coalesce("samples", F.lit(0).cast("long"))).withColumn("ready", (F.coalesce("_all", F.lit(0)) >= READY) & (F.col("samples") > 0))
    r = r.withColumn("expected", F.when(F.col("ready"), F.col("med")).otherwise(F.col("actual")))
    std = F.when(F.col("ready"), F.col("mad")).otherwise(0.0)
    return r.select("cohort", "slot", "actual", F.coalesce("med", "_med", "actual").alias("usual"), "samples", "ready", "expected", std.alias("std"), (F.col("actual") - F.col("expected")).alias("divergence"))
