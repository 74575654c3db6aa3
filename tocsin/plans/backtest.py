"""Replay of history: every slot is scored by the model of its own past, counts are multiplied to see how soon an alarm comes, and what
comes of it is held against the bounds that the detectors promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import surprise, upper_tail
from ..functions.timeutil import DAY, day_of, slot_of_day, weekday
from ..operators.joins import band_join
from ..operators.sequences import consecutive, cusum
from .expectation import causal_expectation

#: Days of history, samples of a group and of the whole history, days with samples, samples of a group that has a variance.
LOOKBACK, GROUP, SAMPLES, DAYS, VARIANCE = 28, 6, 336, 7, 3
#: The surprise of a candidate, the takeoffs and the excess that a public one needs, and the surprises of the tiers.
CANDIDATE, LEAST, EXODUS, TIERS = 2.0, 3, 3.0, {"critical": 17520 / 1, "high": 17520 / 4, "elevated": 17520 / 12}
#: Drift and lines of the cumulative sum, the line of the sum's re-arming, the alarm's threshold in deviations.
K, HIGH, CRITICAL, REARM, THRESHOLD = 1.5, 12.0, 20.0, 6.0, 7.0


def clipped(values: Column) -> Column:
    """The values, cut at their median and four of its roots."""
    s = F.array_sort(values)
    n = F.size(s)
    med = (s[F.floor((n - 1) / 2).cast("int")] + s[F.floor(n / 2).cast("int")]) / 2
    cap = med + 4 * F.sqrt(F.greatest(med, F.lit(1.0)))
    return F.transform(values, lambda v: F.least(v, cap))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def rate(values: Column) -> Column:
    """The mean of the clipped values, half a takeoff added once."""
    return (total(clipped(values)) + 0.5) / F.size(values)


def history(keys: list[str], order: str, first: int, last: int) -> Column:
    return F.collect_list("x").over(Window.partitionBy(*keys).orderBy(order).rangeBetween(first, last))


def walk_forward(rows: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """cohort, slot, n, mean, dispersion, tier, samples, days, ready of each live row of (cohort, slot, n, live): the rate and the dispersion
    of takeoffs that the `lookback` days before the slot give, live rows only.

    Groups (day class and slot) hold a few samples each, so their own history is a frame. The pooled dispersion is a sum over all groups:
    it changes where a sample enters or leaves its group, and is summed up over these changes, by day and then within the day, so that
    no task holds a cohort. Only slots whose groups are thin are joined to the whole history before them.
    """
    reach = lookback * DAY
    live = rows.filter("live").select("cohort", "slot", F.col("n").cast("double").alias("x"), slot_of_day("slot").alias("of_day"))
    live = live.withColumn("class", weekday(day_of("slot")).isin(0, 6))
    group = ["cohort", "class", "of_day"]

    enter = live.select(*group, F.col("slot").alias("at"), "x")
    changes = enter.unionByName(live.select(*group, (F.col("slot") + reach).alias("at"), F.lit(None).cast("double").alias("x"))).groupBy(*group, "at").agg(F.max("x").alias("x"))
    c = changes.withColumn("values", clipped(history(group, "at", -(reach - 1), 0))).withColumn("k", F.size("values")).withColumn("m", F.try_divide(total(F.col("values")), "k"))
    some = (F.col("k") >= VARIANCE) & (F.col("m") > 0)
    chi = F.when(some, F.aggregate("values", F.lit(0.0), lambda a, v: a + F.pow(v - F.col("m"), F.lit(2.0))) / F.col("m")).otherwise(0.0)
    c = c.withColumn("chi", chi).withColumn("free", F.when(some, F.col("k") - 1).otherwise(0)).withColumn("day", day_of("at"))
    before = Window.partitionBy(*group).orderBy("at")
    c = c.select("cohort", "at", "day", *[(F.col(v) - F.coalesce(F.lag(v).over(before), F.lit(0))).alias(v) for v in ("chi", "free", "k")])
    sums = ("chi", "free", "k")
    of_days = c.groupBy("cohort", "day").agg(*[F.sum(v).alias(f"{v}_day") for v in sums])
    past = Window.partitionBy("cohort").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    of_days = of_days.select("cohort", "day", *[F.coalesce(F.sum(f"{v}_day").over(past), F.lit(0)).alias(f"{v}_past") for v in sums])
    today = Window.partitionBy("cohort", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    pooled = c.select("cohort", "at", "day", *[F.coalesce(F.sum(v).over(today), F.lit(0)).alias(v) for v in sums]).distinct().join(of_days, ["cohort", "day"])
    pooled = pooled.select("cohort", F.col("at").alias("slot"), *[(F.col(v) + F.col(f"{v}_past")).alias(v) for v in sums])

    spans = live.groupBy("cohort", day_of("slot").alias("day")).agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    near = spans.select("cohort", F.explode(F.sequence(F.col("day"), F.col("day") + lookback)).alias("day"), "first", "last").groupBy("cohort", "day").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    own = live.withColumn("own", history(group, "slot", -reach, -1)).withColumn("all", history(["cohort", "of_day"], "slot", -reach, -1))
    thin = own.filter(F.size("all") < GROUP).select("cohort", "slot")
    whole = band_join(thin, live.select("cohort", F.col("slot").alias("then"), F.col("x").alias("v")), "slot", "then", reach, -1, ["cohort"]).groupBy("cohort", "slot").agg(F.collect_list("v").alias("whole"))
    out = own.withColumn("day", day_of("slot")).join(near, ["cohort", "day"]).join(pooled, ["cohort", "slot"]).join(whole, ["cohort", "slot"], "left")
    tier = F.when(F.size("own") >= GROUP, "class").when(F.size("all") >= GROUP, "slot").otherwise("global")
    mean = F.when(F.size("own") >= GROUP, rate(F.col("own"))).when(F.size("all") >= GROUP, rate(F.col("all"))).otherwise(rate(F.col("whole")))
    days = F.size(F.filter("spans", lambda s: (s.last >= F.col("slot") - reach) & (s.first < F.col("slot"))))
    dispersion = F.greatest(F.lit(1.0), F.coalesce(F.try_divide("chi", "free"), F.lit(1.0)))
    out = out.select("cohort", "slot", F.col("x").cast("long").alias("n"), mean.alias("mean"), dispersion.alias("dispersion"), tier.alias("tier"), F.col("k").cast("long").alias("samples"), days.cast("long").alias("days"))
    return out.withColumn("ready", (F.col("samples") >= SAMPLES) & (F.col("days") >= min(DAYS, lookback)))


def replayed(rows: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """walk_forward's ready slots with surprise, and severity: by the model's thresholds alone, which the record can only raise; watch where
    the count isn't EXODUS times the mean, null under CANDIDATE."""
    w = walk_forward(rows, lookback).filter("ready")
    w = w.withColumn("surprise", surprise(upper_tail("n", F.greatest("mean", F.lit(1e-9)), F.col("dispersion"))))
    enough = F.col("n") >= F.greatest(F.lit(float(LEAST)), EXODUS * F.col("mean"))
    severity = F.when(F.col("surprise") < CANDIDATE, F.lit(None))
    for name, odds in TIERS.items():
        severity = severity.when(enough & (F.pow(F.lit(10.0), "surprise") >= odds), name)
    return w.withColumn("severity", severity.otherwise("watch"))


def levels(slots: DataFrame, series: str | None = None) -> DataFrame:
    """series, slot, n, expected, z, level, s, ready: slots against their own past, and the cumulative sum of z over the ready ones."""
    e = causal_expectation(slots, series)
    z = F.when(F.col("ready"), (F.col("n") - F.col("expected")) / F.col("std")).otherwise(0.0)
    e = cusum(e.withColumn("z", z), ["series", "ready"], "slot", F.col("z"), K).withColumn("s", F.when(F.col("ready"), F.col("s")).otherwise(0.0))
    level = F.when(F.col("z") >= THRESHOLD, 5).otherwise(F.least(F.lit(4), F.floor(4 * F.greatest("z", F.lit(0.0)) / THRESHOLD) + 1))
    return e.select("series", "slot", "n", "expected", "z", level.cast("long").alias("level"), "s", "ready")


def crossings(scored: DataFrame) -> DataFrame:
    """series, slot, severity, s of levels()'s rows where a line is first crossed since the sum was last under REARM."""
    r = scored.filter("ready")
    for name, line in (("high", HIGH), ("critical", CRITICAL)):  # the k-th row over the line in a stretch that stays over REARM
        r = consecutive(r, "series", "slot", F.col("s") >= REARM, "_over").withColumn("_start", F.row_number().over(Window.partitionBy("series").orderBy("slot")) - F.col("_over"))
        r = r.withColumn(f"_{name}", F.sum((F.col("s") >= line).cast("int")).over(Window.partitionBy("series", "_start").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))).drop("_over", "_start")
    first = lambda name, line: (F.col("s") >= line) & (F.col(f"_{name}") == 1)
    out = r.withColumn("severity", F.when(first("critical", CRITICAL), "critical").when(first("high", HIGH), "high"))
    return out.filter("severity IS NOT NULL").select("series", "slot", "severity", "s")


def injections(slots: DataFrame, factors: list[float], minutes: int = 120) -> DataFrame:
    """series (the factor), factor, slot, n of the whole history, the last `minutes` of it multiplied by each factor."""
    last = slots.agg(F.max("slot").alias("_last"))  # one row
    f = slots.crossJoin(F.broadcast(last)).withColumn("factor", F.explode(F.array(*[F.lit(float(x)) for x in factors])))
    late = F.col("slot") > F.col("_last") - minutes * 60
    return f.select(F.col("factor").cast("string").alias("series"), "factor", "slot", F.when(late, F.floor(F.col("n") * F.col("factor") + 0.5)).otherwise(F.col("n")).cast("long").alias("n"))


def time_to_alarm(slots: DataFrame, factors: list[float], minutes: int = 120) -> DataFrame:
    """factor, high, critical: minutes from the beginning of an injection to the end of the slot in which each level is reached, by the level
    of a slot or by the sum; null where it isn't."""
    scored = levels(injections(slots, factors, minutes), "series")
    last = slots.agg(F.max("slot").alias("_last"))
    late = scored.crossJoin(F.broadcast(last)).filter(F.col("slot") > F.col("_last") - minutes * 60)
    at = (F.col("slot") - F.col("_last") + minutes * 60) / 60
    first = lambda level, line: F.min(F.when((F.col("level") >= level) | (F.col("s") >= line), at)).cast("long")
    return late.groupBy(F.col("series").cast("double").alias("factor")).agg(first(4, HIGH).alias("high"), first(5, CRITICAL).alias("critical"))


def bounds(replay: DataFrame, scored: DataFrame, alarms: DataFrame, factor: float = 3.0) -> DataFrame:
    """bound, value, most, ok: of replayed(), levels() and time_to_alarm() what the detectors promise; most is a least for warm slots."""
    r = replay.agg(
        F.count_if(F.col("severity") == "critical").cast("double").alias("takeoff criticals"), F.count_if(F.col("severity").isin(*TIERS)).cast("double").alias("takeoff public alerts"),
        F.coalesce(F.avg((F.col("surprise") >= 2).cast("double")), F.lit(0.0)).alias("share of 1-in-100 scores"), F.count("*").cast("double").alias("warm slots"),
        F.coalesce(F.count_distinct(day_of("slot")), F.lit(0)).alias("days"),
    )
    days = scored.filter("ready").groupBy("series", day_of("slot").alias("day")).agg(F.max("level").alias("peak"), F.count("*").alias("k"))
    c = days.agg(F.count("*").alias("scored_days"), F.coalesce(F.sum("k"), F.lit(0)).alias("scored_slots"), F.count_if(F.col("peak") >= 5).cast("double").alias("level 5 days"), F.count_if(F.col("peak") >= 4).cast("double").alias("level 4 days"))
    x = crossings(scored).agg(F.count("*").cast("double").alias("crossings"), F.count_if(F.col("severity") == "critical").cast("double").alias("critical crossings"))
    a = alarms.filter(F.col("factor") == factor).agg(F.max("high").cast("double").alias("minutes to high"), F.max("critical").cast("double").alias("minutes to critical"))
    one = r.crossJoin(c).crossJoin(x).crossJoin(a)  # four rows in all
    months = F.col("scored_slots") / 48
    most = {
        "minutes to high": F.lit(60.0), "minutes to critical": F.lit(120.0), "takeoff criticals": F.lit(0.0), "takeoff public alerts": F.ceil(F.col("days") * 12 / 365) + 2,
        "share of 1-in-100 scores": F.lit(0.02), "warm slots": F.lit(float(SAMPLES)), "crossings": F.ceil(months / 20), "critical crossings": F.ceil(months / 60),
        "level 5 days": F.ceil(F.greatest("scored_days", F.lit(1)) / 30), "level 4 days": F.ceil(F.greatest("scored_days", F.lit(1)) / 15),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("bound"), F.col(k).alias("value"), v.cast("double").alias("most")) for k, v in most.items()]))
    ok = F.coalesce(F.when(F.col("bound") == "warm slots", F.col("value") >= F.col("most")).otherwise(F.col("value") <= F.col("most")), F.lit(False))
    return one.select(rows.alias("b")).select("b.*").withColumn("ok", ok)
