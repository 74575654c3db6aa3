"""What a count series is expected to be at a slot, from earlier slots only.

The base of a slot blends decayed means of the same time of day and of the same time of the week, each with its neighbour slots. What
the calendar adds to it is learnt from the bases' residuals half a year or more ago, or from the smoothed ratios of prior years. The
base needs no prediction, so nothing here runs slot by slot: each step is a join on (series, slot of day) or on a day, and a sum.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, half_life_weight
from ..functions.timeutil import DAY, day_of, slot_of_day, weekday
from ..operators.joins import band_join

#: Days of history, half-lives in days of both means, samples that halve the week's weight, samples before the model is ready, least deviation.
LOOKBACK, DAY_HALF_LIFE, WEEK_HALF_LIFE, WEEK_SHRINK, READY, LEAST_STD = 28, 2.0, 3.0, 2.0, 336, 8.0
#: Fixed values of the calendar's residuals: ages in days, reach and scale in days of the year, half-life, weight of other weekdays, shrinkage.
CALENDAR_AGES, CALENDAR_REACH, CALENDAR_SCALE, CALENDAR_HALF_LIFE, OTHER_WEEKDAY, CALENDAR_SHRINK = (180, 1098), 7, 2.5, 732.0, 0.6, 2.0
#: Fixed values of the prior years' ratios: years, reach in days and slots, scales of both, half-life in years, shrinkage, bounds.
YEARS, DAY_REACH, SLOT_REACH, DAY_SCALE, SLOT_SCALE, YEAR_HALF_LIFE, YEAR_SHRINK, RATIOS = 3, 2, 5, 1.25, 3.125, 2.0, 1.0, (0.25, 2.25)
#: The two means: what stands in their columns' names, and their half-lives.
MEANS = (("d", DAY_HALF_LIFE), ("w", WEEK_HALF_LIFE))


def gauss(x: Column, scale: float) -> Column:
    return F.exp(-0.5 * F.pow(x / scale, F.lit(2.0)))


def mean_of(*values: Column) -> Column:
    """The mean of those that aren't null."""
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / n)


def surroundings(rows: DataFrame, x: str) -> DataFrame:
    """series, slot, mean_d, rms_d, mean_w, rms_w, n_w of each row that has earlier ones around it: decayed over LOOKBACK days, of the slot
    and its two neighbours around the clock on all days (d) and on the same weekday (w), each slot's value counting as one."""
    left = rows.select("series", slot_of_day("slot").alias("of_day"), "slot", weekday(day_of("slot")).alias("weekday"))
    side = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    right = rows.filter(F.col(x).isNotNull()).select("series", F.col("slot").alias("then"), F.col(x).cast("double").alias("x"), weekday(day_of("slot")).alias("then_weekday"), side.alias("side"))
    right = right.withColumn("of_day", F.pmod(slot_of_day("then") + F.col("side"), F.lit(48)))
    near = band_join(left, right, "slot", "then", LOOKBACK * DAY, -1, ["series", "of_day"])
    age = (F.col("slot") - F.col("then")) / DAY
    sums = []
    for tag, half_life in MEANS:
        for k in (-1, 0, 1):
            here = (F.col("side") == k) if tag == "d" else (F.col("side") == k) & (F.col("weekday") == F.col("then_weekday"))
            w = F.when(here, half_life_weight(age, half_life))
            sums += [(F.sum(w * v) / F.sum(w)).alias(f"{tag}{p}{k + 1}") for p, v in enumerate((F.col("x"), F.col("x") * F.col("x")))]
    out = near.groupBy("series", "slot").agg(*sums, F.count_if(F.col("weekday") == F.col("then_weekday")).alias("n_w"))
    each = lambda tag, p, f: mean_of(*[f(F.col(f"{tag}{p}{k}")) for k in range(3)])
    return out.select("series", "slot", "n_w", *[each(t, p, f).alias(f"{name}_{t}") for t, _ in MEANS for p, name, f in ((0, "mean", lambda c: c), (1, "rms", F.sqrt))])


def blended(day: Column, week: Column, n_week: Column) -> Column:
    """The week's value with weight n / (n + WEEK_SHRINK), the day's with the rest; one alone where the other is null."""
    b = n_week / (n_week + WEEK_SHRINK)
    return F.when(day.isNotNull() & week.isNotNull(), (1 - b) * day + b * week).otherwise(F.coalesce(day, F.when(b > 0, week)))


def ready(rows: DataFrame) -> DataFrame:
    """rows with ready: READY rows or more of the series lie before. Days are summed up, so no task holds a series' rows."""
    by_day = rows.groupBy("series", day_of("slot").alias("_day")).agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy("series").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    by_day = by_day.select("series", "_day", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("series", "_day").orderBy("slot"))
    out = rows.withColumn("_day", day_of("slot")).join(by_day, ["series", "_day"]).withColumn("ready", F.col("_before") + own > READY)
    return out.drop("_day", "_before")


def day_of_year(slot: str) -> Column:
    return F.dayofyear(F.timestamp_seconds(slot).cast("date")) - 1


def calendar_residuals(rows: DataFrame) -> DataFrame:
    """series, slot, adjustment, weight: the mean residual of days at about this time of the year, CALENDAR_AGES old; rows have base and ready."""
    learnt = rows.filter("ready").groupBy("series", day_of("slot").alias("day")).agg(F.avg(F.col("n") - F.col("base")).alias("residual"), F.count("*").alias("k"))
    began = rows.groupBy("series", day_of("slot").alias("day")).agg(F.min("slot").alias("then"))
    e = learnt.join(began, ["series", "day"]).withColumn("doy", day_of_year("then")).withColumn("off", F.explode(F.sequence(F.lit(-CALENDAR_REACH), F.lit(CALENDAR_REACH))))
    e = e.select("series", F.pmod(F.col("doy") + F.col("off"), F.lit(366)).alias("doy"), "off", "then", "residual", "k", weekday("day").alias("then_weekday"))
    left = rows.select("series", "slot", day_of_year("slot").alias("doy"), weekday(day_of("slot")).alias("weekday"))
    near = band_join(left, e, "slot", "then", CALENDAR_AGES[1] * DAY, -CALENDAR_AGES[0] * DAY, ["series", "doy"])
    age = (F.col("slot") - F.col("then")) / DAY
    w = gauss(F.col("off"), CALENDAR_SCALE) * half_life_weight(age, CALENDAR_HALF_LIFE) * F.when(F.col("weekday") == F.col("then_weekday"), 1.0).otherwise(OTHER_WEEKDAY) * F.greatest(F.lit(1.0), F.sqrt("k"))
    total = near.groupBy("series", "slot").agg(F.sum(w).alias("w"), F.sum(w * F.col("residual")).alias("wr"))
    return total.select("series", "slot", (F.col("wr") / F.col("w")).alias("adjustment"), (F.col("w") / (F.col("w") + CALENDAR_SHRINK)).alias("weight"))


def prior_years(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """series, slot, ratio, adjustment, weight: ratios of counts to bases at the same local date and time of up to YEARS years before,
    smoothed by two Gaussians. Each entry's weight is spread over the slots around it, then over the days; a slot reads one cell a year."""
    local = F.from_utc_timestamp(F.timestamp_seconds("slot"), zone)
    at = [local.cast("date").alias("date"), (F.hour(local) * 2 + F.floor(F.minute(local) / 30)).cast("int").alias("of_day")]
    entry = rows.filter("ready AND base > 0").select("series", *at, (F.col("n") / F.col("base")).alias("ratio"))
    moved = F.col("of_day") + F.col("off")
    s = entry.withColumn("off", F.explode(F.sequence(F.lit(-SLOT_REACH), F.lit(SLOT_REACH)))).withColumn("g", gauss(F.col("off"), SLOT_SCALE))
    s = s.groupBy("series", F.date_add("date", F.floor(moved / 48).cast("int")).alias("date"), F.pmod(moved, F.lit(48)).alias("of_day")).agg(F.sum("g").alias("w"), F.sum(F.col("g") * F.col("ratio")).alias("wr"))
    d = s.withColumn("off", F.explode(F.sequence(F.lit(-DAY_REACH), F.lit(DAY_REACH)))).withColumn("g", gauss(F.col("off"), DAY_SCALE))
    field = d.groupBy("series", F.date_add("date", F.col("off")).alias("date"), "of_day").agg(F.sum(F.col("g") * F.col("w")).alias("w"), F.sum(F.col("g") * F.col("wr")).alias("wr"))
    then = F.date_add(F.make_date(F.year("date") - F.col("years"), F.month("date"), F.lit(1)), F.dayofmonth("date") - 1)  # 29 February becomes 1 March
    left = rows.select("series", "slot", "base", *at).withColumn("years", F.explode(F.sequence(F.lit(1), F.lit(YEARS)))).withColumn("date", then)
    g = half_life_weight(F.col("years") - 1, YEAR_HALF_LIFE)
    total = left.join(field, ["series", "date", "of_day"]).groupBy("series", "slot", "base").agg(F.sum(g * F.col("w")).alias("w"), F.sum(g * F.col("wr")).alias("wr"))
    ratio = clamp(F.col("wr") / F.col("w"), *RATIOS)
    return total.filter("base > 0").select("series", "slot", ratio.alias("ratio"), (F.col("base") * (ratio - 1)).alias("adjustment"), (F.col("w") / (F.col("w") + YEAR_SHRINK)).alias("weight"))


def causal_expectation(slots: DataFrame, series: str | None = None, annual: bool = False, zone: str = "UTC") -> DataFrame:
    """series, slot, n, base, adjustment, weight, expected, std, ready of each of (slot, n).

    expected is the base with the calendar's adjustment by its weight: of residuals half a year and more ago or, with annual, of the
    smoothed ratios of prior years where there are any. std is blended as the base is, from the expectation's own residuals, and where
    there are none from the counts. Until READY samples lie before, expected is the count itself.
    """
    rows = slots.select((F.col(series).cast("string") if series else F.lit("all")).alias("series"), "slot", F.col("n").cast("double").alias("n"))
    around = surroundings(rows, "n")
    first = ready(rows).join(around, ["series", "slot"], "left")
    base = blended(F.col("mean_d"), F.col("mean_w"), F.coalesce("n_w", F.lit(0)))
    first = first.withColumn("any", base.isNotNull()).withColumn("base", F.coalesce(base, "n")).withColumn("ready", F.col("ready") & F.col("any")).drop("any")
    calendar = calendar_residuals(first.select("series", "slot", "n", "base", "ready"))
    out = first.join(calendar, ["series", "slot"], "left")
    if annual:
        years = prior_years(first.select("series", "slot", "n", "base", "ready"), zone).select("series", "slot", F.col("adjustment").alias("a"), F.col("weight").alias("b"))
        out = out.join(years, ["series", "slot"], "left").withColumn("weight", F.when(F.col("a").isNotNull(), F.col("b")).otherwise(F.col("weight"))).withColumn("adjustment", F.coalesce("a", "adjustment"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("adjustment", "weight")})
    out = out.withColumn("expected", F.when(F.col("ready"), F.col("base") + F.col("adjustment") * F.col("weight")).otherwise(F.col("n")))
    residual = out.select("series", "slot", F.when(F.col("ready"), F.col("n") - F.col("expected")).alias("residual"))
    scale = surroundings(residual, "residual").select("series", "slot", F.col("rms_d").alias("own_d"), F.col("rms_w").alias("own_w"))
    out = out.join(scale, ["series", "slot"], "left")
    std = blended(F.coalesce("own_d", "rms_d"), F.coalesce("own_w", "rms_w"), F.coalesce("n_w", F.lit(0)))
    std = F.when(F.col("ready"), F.greatest(F.lit(LEAST_STD), F.coalesce(std, F.lit(LEAST_STD)))).otherwise(LEAST_STD)
    return out.select("series", "slot", F.col("n").cast("long").alias("n"), "base", "adjustment", "weight", "expected", std.alias("std"), "ready")
