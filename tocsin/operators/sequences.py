"""Operators on ordered rows of a key: transitions, segments, runs, cumulative sums, and small state machines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key, order) -> Window:
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    return Window.partitionBy(*key).orderBy(*order)


def transitions(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Rows whose flag is true after a row of the key whose flag was false, with previous (the first order column there).
    A key's first row is no transition."""
    w = by(key, order)
    return rows.withColumn("_before", F.lag(flag).over(w)).withColumn("previous", F.lag(order[0]).over(w)).filter(F.col(flag) & ~F.col("_before")).drop("_before")


def islands(rows: DataFrame, key, order, starts: Column, name: str = "island") -> DataFrame:
    """rows with the number of their run; `starts` says where a new one begins (it may use lag over by(key, order))."""
    w = by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("long")).withColumn(name, F.sum("_starts").over(w)).drop("_starts")


def gap_segments(rows: DataFrame, key: str, time: str, least_gap: int = 86400, factor: float = 2.0) -> DataFrame:
    """key, segment_start, segment_end, n of the longest run between gaps over max(least_gap, factor times the median positive
    step); the latest of equals."""
    steps = rows.select(key, time).withColumn("_step", F.col(time) - F.lag(time).over(by(key, time)))
    usual = steps.filter("_step > 0").groupBy(key).agg(F.percentile("_step", 0.5).alias("_usual"))
    limit = F.greatest(F.lit(float(least_gap)), factor * F.coalesce("_usual", F.lit(0.0)))
    cut = islands(steps.join(usual, key, "left"), key, time, (F.col("_step") > limit))
    runs = cut.groupBy(key, "island").agg(F.min(time).alias("segment_start"), F.max(time).alias("segment_end"), F.count("*").alias("n"))
    best = runs.groupBy(key).agg(F.max(F.struct("n", "segment_end", "segment_start")).alias("b"))
    return best.select(key, "b.segment_start", "b.segment_end", "b.n")


def sessions(rows: DataFrame, key: str, time: str, order: list[str], gap: int) -> DataFrame:
    """rows with session, from 1, a new one after more than gap seconds."""
    step = F.col(time) - F.lag(time).over(by(key, order))
    return islands(rows, key, order, step > gap, "session")


def run_lengths(rows: DataFrame, key, order, value: str) -> DataFrame:
    """key, run (from 1), value, n, first (of the first order column): adjacent equal values are one run."""
    keys, first = ([key] if isinstance(key, str) else list(key)), ([order] if isinstance(order, str) else list(order))[0]
    cut = islands(rows, key, order, ~F.col(value).eqNullSafe(F.lag(value).over(by(key, order))) | F.lag(F.lit(1)).over(by(key, order)).isNull(), "run")
    return cut.groupBy(*keys, "run", value).agg(F.count("*").alias("n"), F.min(first).alias("first"))


def expand_runs(runs: DataFrame, key: str, run: str, delta: str, n: str, start: Column) -> DataFrame:
    """The series that run_lengths of its steps came from: key, value."""
    each = runs.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    w = by(key, [run, "_i"]).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(key, (start + F.sum(delta).over(w)).alias("value"))


def cusum(rows: DataFrame, key, order, z: Column, k: float, lo: float = -4.0, hi: float = 8.0, name: str = "s") -> DataFrame:
    """rows with S = max(0, S + clamp(z) - k), by running sums: C less the least of zero and all C so far."""
    w = by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.greatest(F.lit(lo), F.least(F.lit(hi), z)) - k
    c = rows.withColumn("_c", F.sum(step).over(w))
    return c.withColumn(name, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).drop("_c")


def consecutive(rows: DataFrame, key, order, flag: Column, name: str = "streak") -> DataFrame:
    """rows with how many rows up to this one have the flag without a break; 0 where it is false."""
    w = by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_run", F.sum((~F.col("_flag")).cast("long")).over(w))
    keys = [key] if isinstance(key, str) else list(key)
    return marked.withColumn(name, F.sum(F.col("_flag").cast("long")).over(by([*keys, "_run"], order).rowsBetween(Window.unboundedPreceding, 0))).drop("_flag", "_run")


class CusumAlarm:
    """State of one series: the sum, and which levels are armed. One step function serves batch and stream."""

    #: The drift that is allowed, the lines of both levels, and the sum under which they are armed again.
    K, HIGH, CRITICAL, REARM = 1.5, 12.0, 20.0, 6.0

    def __init__(self, s: float = 0.0, fired: int = 0, last: int = -(1 << 62), tie: int = 0):
        self.s, self.fired, self.last, self.tie = s, fired, last, tie

    def step(self, t: int, z: float, tie: int = 0, frozen: bool = False) -> str | None:
        """The level newly crossed. A sample no later than the last one changes nothing; of one time, the larger tie is later. A frozen
        sample (of a holiday that no baseline has learnt) only moves the clock."""
        if (t, tie) <= (self.last, self.tie):
            return None
        self.last, self.tie = t, tie
        if frozen:
            return None
        self.s = max(0.0, self.s + min(8.0, max(-4.0, z)) - self.K)
        if self.s < self.REARM:
            self.fired = 0
        level = 2 if self.s >= self.CRITICAL else 1 if self.s >= self.HIGH else 0
        if level > self.fired:
            self.fired = level
            return ("high", "critical")[level - 1]
        return None


def cusum_crossings(rows: DataFrame, key: str, time: str, z: str, tie: str | None = None, frozen: str | None = None) -> DataFrame:
    """key, time, severity, s of each crossing; a level fires once until the sum falls under the re-arming line. Where samples of a key may
    share a time, tie is a number that tells them apart; frozen says which samples don't count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alarm, out = CusumAlarm(), []
        for k, t, x, i, still in pdf.sort_values([time, "_tie"])[[key, time, z, "_tie", "_frozen"]].itertuples(index=False, name=None):
            if severity := alarm.step(t, x, i, still):
                out.append((k, t, severity, alarm.s))
        return pd.DataFrame(out, columns=[key, time, "severity", "s"])

    kind = rows.schema[key].dataType.simpleString()
    more = (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), F.coalesce(F.col(frozen) if frozen else F.lit(False), F.lit(False)).alias("_frozen")
    return rows.select(key, time, z, *more).groupBy(key).applyInPandas(run, f"{key} {kind}, {time} long, severity string, s double")


def cooldown(rows: DataFrame, key: list[str], time: str, seconds: int) -> DataFrame:
    """Of each key the rows that come more than so long after the last one kept."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, keep = None, []
        pdf = pdf.sort_values(time, kind="stable")
        for t in pdf[time]:
            ok = last is None or t - last > seconds
            last = t if ok else last
            keep.append(ok)
        return pdf[keep]

    return rows.groupBy(*key).applyInPandas(run, rows.schema)


def rate_limited(rows: DataFrame, key: str, time: str, severity: str, seconds: int) -> DataFrame:
    """rows with severity 'watch' where a public one (high, critical) came less than so long before within the key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        pdf = pdf.sort_values(time, kind="stable")
        for t, s in zip(pdf[time], pdf[severity]):
            if s in ("high", "critical"):
                if last is not None and t - last < seconds:
                    s = "watch"
                else:
                    last = t
            out.append(s)
        return pdf.assign(**{severity: out})

    return rows.groupBy(key).applyInPandas(run, rows.schema)


def adjacent_distinct(rows: DataFrame, key: str, order: list[str], values: list[Column]) -> DataFrame:
    """rows without those whose values equal the row's before."""
    v = F.struct(*[x.alias(f"v{i}") for i, x in enumerate(values)])
    return rows.withColumn("_same", v.eqNullSafe(F.lag(v).over(by(key, order)))).filter(~F.col("_same")).drop("_same")


def rolling_distinct(rows: DataFrame, key: str, time: str, value: str, seconds: int, name: str = "distinct") -> DataFrame:
    """rows with how many different values the key has from the row's time on for so many seconds."""
    w = Window.partitionBy(key).orderBy(time).rangeBetween(0, seconds)
    return rows.withColumn(name, F.size(F.collect_set(value).over(w)).cast("long"))


def hour_overlaps(windows: DataFrame, start: str, end: str) -> DataFrame:
    """windows with each hour they touch and the share of the hour inside."""
    hours = windows.withColumn("hour", F.explode(F.sequence(F.floor(F.col(start) / 3600), F.floor((F.col(end) - 1) / 3600))))
    inside = F.least(F.col(end), (F.col("hour") + 1) * 3600) - F.greatest(F.col(start), F.col("hour") * 3600)
    return hours.withColumn("weight", inside / 3600.0)


def best_burst(rows: DataFrame, key: str, time: str, residual: str, least: float = 80.0, share: float = 0.3) -> DataFrame:
    """key, burst_start, burst_end, total: the window of residuals at or over max(least, share of the peak), with at most one weaker but
    not negative row between any two strong ones, whose sum is largest; the earliest of equals. Keys without one have no row."""
    w = by(key, time)
    r = rows.select(key, time, F.col(residual).alias("_r")).withColumn("_at", F.row_number().over(w)).withColumn("_weak", F.lag("_r").over(w))
    line = F.greatest(F.lit(least), share * F.max("_r").over(Window.partitionBy(key)))
    strong = r.withColumn("_line", line).filter(F.col("_r") >= F.col("_line")).withColumn("_step", F.col("_at") - F.lag("_at").over(w))
    bridged = (F.col("_step") == 2) & (F.col("_weak") >= 0)
    strong = islands(strong, key, time, ~((F.col("_step") == 1) | bridged), "_burst").withColumn("_sum", F.col("_r") + F.when(bridged, F.col("_weak")).otherwise(0.0))
    each = strong.groupBy(key, "_burst").agg(F.min(time).alias("burst_start"), F.max(time).alias("burst_end"), F.sum("_sum").alias("total"))
    best = each.groupBy(key).agg(F.min(F.struct((-F.col("total")).alias("d"), "burst_start", "burst_end", "total")).alias("b"))
    return best.select(key, "b.burst_start", "b.burst_end", "b.total")


def byte_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Of each key the rows that fit a budget when taken in order, those passed over leaving room for smaller ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        pdf = pdf.sort_values(order, kind="stable")
        for n in pdf[size]:
            keep.append(n <= left)
            left -= n if keep[-1] else 0
        return pdf[keep]

    return rows.groupBy(key).applyInPandas(run, rows.schema)


def phase_runs(rows: DataFrame, key: str, order, phase: str, unknown: str) -> DataFrame:
    """Runs of equal phases once unknown ones are left out, so that they part no run."""
    return run_lengths(rows.filter(F.col(phase) != unknown), key, order, phase)


def cusum_stretches(rows: DataFrame, key: str, time: str, z: Column, k: float, step: int, name: str = "s") -> DataFrame:
    """cusum that begins anew after a gap of more than a step."""
    cut = islands(rows, key, time, F.col(time) - F.lag(time).over(by(key, time)) > step, "_stretch")
    return cusum(cut, [key, "_stretch"], time, z, k, name=name).drop("_stretch")
