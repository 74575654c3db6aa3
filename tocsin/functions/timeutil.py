"""Time as seconds, slots and calendars. Sunday is weekday 0; a week has 336 half-hour slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HALF_HOUR, DAY = 1800, 86400


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unix(ts) -> Column:
    """Seconds of a (UTC) timestamp, with or without zone."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def half_hour_floor(t) -> Column:
    return _c(t) - F.pmod(_c(t), F.lit(HALF_HOUR))


def half_hour_round(t) -> Column:
    """To the nearest half hour, up from the middle."""
    return half_hour_floor(_c(t) + HALF_HOUR // 2)


def day_of(t) -> Column:
    """Days since 1970 of seconds."""
    return F.floor(_c(t) / DAY).cast("long")


def slot_of_day(t) -> Column:
    return F.floor(F.pmod(_c(t), F.lit(DAY)) / HALF_HOUR).cast("long")


def weekday(day) -> Column:
    """0 (Sunday) to 6 of days since 1970, which began on a Thursday."""
    return F.pmod(_c(day) + 4, F.lit(7))


def week_slot(t) -> Column:
    return weekday(day_of(t)) * 48 + slot_of_day(t)


def local_week_slot(ts, zone) -> Column:
    """Week slot on the clocks of a zone, daylight saving included."""
    local = F.from_utc_timestamp(_c(ts).cast("timestamp"), zone)
    return (F.dayofweek(local) - 1) * 48 + F.hour(local) * 2 + (F.minute(local) >= 30).cast("int")


def circular_distance(a, b, n: int) -> Column:
    d = F.pmod(_c(a) - _c(b), F.lit(n))
    return F.least(d, n - d)


def strict_offset_timestamp(text) -> Column:
    """A timestamp whose offset is written out and whose day exists; else null."""
    pattern = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"
    return F.when(_c(text).rlike(pattern), F.try_to_timestamp(_c(text)))


#: US federal holidays. Fixed dates as (month, day); floating ones as (month, weekday from Sunday 0, which of the month, 0 for the last).
FIXED = {"new_year": (1, 1), "juneteenth": (6, 19), "independence": (7, 4), "veterans": (11, 11), "christmas": (12, 25)}
FLOATING = {"mlk": (1, 1, 3), "presidents": (2, 1, 3), "memorial": (5, 1, 0), "labor": (9, 1, 1), "columbus": (10, 1, 2), "thanksgiving": (11, 4, 4)}
JUNETEENTH_FROM = 2021


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday, day (date), year: a small dimension, 11 rows a year at most."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    out = None
    for name, (m, d) in FIXED.items():
        part = years.select(F.lit(name).alias("holiday"), F.make_date("year", F.lit(m), F.lit(d)).alias("day"), "year")
        part = part.filter(F.col("year") >= JUNETEENTH_FROM) if name == "juneteenth" else part
        out = part if out is None else out.unionByName(part)
    for name, (m, w, n) in FLOATING.items():
        first = F.make_date("year", F.lit(m), F.lit(1))
        dow = ["SU", "MO", "TU", "WE", "TH", "FR", "SA"][w]
        at = F.date_add(F.next_day(F.date_sub(first, 1), dow), 7 * (n - 1)) if n else F.date_sub(F.next_day(F.last_day(first), dow), 7)
        out = out.unionByName(years.select(F.lit(name).alias("holiday"), at.alias("day"), "year"))
    return out


def nearest_holiday(days: DataFrame, day_col: str, spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """days with holiday, offset: the closest one within two days before or after (three after new year and Thanksgiving), the earlier on ties."""
    h = holidays(spark, first_year - 1, last_year + 1).select("holiday", F.col("day").alias("holiday_day"))
    reach = F.when(F.col("holiday").isin("new_year", "thanksgiving"), 3).otherwise(2)
    near = h.select("*", F.explode(F.sequence(F.lit(-2), reach)).alias("offset")).withColumn(day_col, F.date_add("holiday_day", F.col("offset")))
    best = near.groupBy(day_col).agg(F.min_by(F.struct("holiday", "offset"), F.struct(F.abs("offset"), "holiday_day")).alias("h"))
    return days.join(F.broadcast(best), day_col, "left").select(*days.columns, F.col("h.holiday").alias("holiday"), F.col("h.offset").alias("offset"))
