"""Keyed writes and selections: upserts, severity gates, paging, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import public_severity, severity_rank


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and those new rows whose keys it lacks, one a key."""
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def upsert_latest(target: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row a key: that of the highest version, the new one on ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*target.columns)


def severity_upsert(target: DataFrame, new: DataFrame, key: str = "event_key") -> DataFrame:
    """Alerts (key, severity, t, status) after a batch. A new key is pending. An old one takes the new time; a rise to a higher
    public severity makes it pending again, otherwise a status once reached stays, and severity never falls."""
    n = new.select(key, F.col("severity").alias("_severity"), F.col("t").alias("_t"))
    both = target.join(n, key, "full_outer")
    old, fresh = severity_rank("severity"), severity_rank("_severity")
    rise = (fresh > old) & public_severity("_severity")
    return both.select(
        key,
        F.when(fresh > old, F.col("_severity")).otherwise(F.col("severity")).alias("severity"),
        F.greatest("t", "_t").alias("t"),
        F.when(F.col("status").isNull() | rise, F.lit("pending")).otherwise(F.col("status")).alias("status"),
    )


def unpublished(alerts: DataFrame, publications: DataFrame, key: str = "event_key") -> DataFrame:
    """Public alerts without a publication at their severity."""
    return alerts.filter(public_severity("severity")).join(publications.select(key, "severity"), [key, "severity"], "left_anti")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*rows.columns)


def last_n(rows: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n rows of each key that come first in order, with their place from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col(rank) <= n)


def keyset_page(rows: DataFrame, rank: Column, time: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """A page in the order rank down, time down, key up; after is the last (rank, time, key) seen."""
    rows = rows.withColumn("_rank", rank)
    if after:
        r, t, k = after
        rows = rows.filter((F.col("_rank") < r) | ((F.col("_rank") == r) & ((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) > k)))))
    return rows.orderBy(F.desc("_rank"), F.desc(time), F.asc(key)).limit(size).withColumnRenamed("_rank", "rank")


def round_robin(rows: DataFrame, group: str, order: list[Column], recency: str, n: int) -> DataFrame:
    """n rows, the newest of each group first, then the second of each, groups with the latest row leading."""
    ranked = last_n(rows, group, order, n, "turn_no")
    newest = rows.groupBy(group).agg(F.max(recency).alias("_newest"))
    return ranked.join(newest, group).orderBy("turn_no", F.desc("_newest"), group).limit(n).drop("_newest")


def missing_steps(observed: DataFrame, time: str, step: int) -> DataFrame:
    """The steps between the first and the last time that have no row."""
    ends = observed.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.lit(step))).alias(time)).join(observed.select(time), time, "left_anti")


def merge_counts(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, x, y, delta = x - y, with 0 where one side lacks a key."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, keys, "full_outer").select(*keys, zero(x).alias(x), zero(y).alias(y), (zero(x) - zero(y)).alias("delta"))


def top_counts(rows: DataFrame, value: Column, n: int, name: str = "value") -> DataFrame:
    """The n commonest values, ties by value."""
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def optional_filters(rows: DataFrame, **wanted) -> DataFrame:
    """rows whose columns equal the wanted values; None asks for nothing."""
    for c, v in wanted.items():
        rows = rows if v is None else rows.filter(F.col(c) == v)
    return rows


def retained(rows: DataFrame, time: str, now: int, seconds: int) -> DataFrame:
    """rows of the last seconds before now: a plain filter, so that it reaches the scan."""
    return rows.filter(F.col(time) >= now - seconds)


def batch_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows in the order of a key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def top_of_tops(parts: list[DataFrame], order: list[Column], n: int) -> DataFrame:
    """The first n rows of several tables, each giving no more than its own first n."""
    best = [p.orderBy(*order).limit(n) for p in parts]
    out = best[0]
    for p in best[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order).limit(n)


def zipped(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, place (from 0), left, right: two arrays of a row taken side by side; the shorter one ends in nulls."""
    at = rows.select(key, F.posexplode(F.arrays_zip(left, right)).alias("place", "_z"))
    return at.select(key, F.col("place").cast("long").alias("place"), f"_z.{left}", f"_z.{right}")


def enrolled(rows: DataFrame, source: str, poll: str) -> DataFrame:
    """rows with history: whether they come from their source's first poll, which opens no incident."""
    first = rows.groupBy(source).agg(F.min(poll).alias("_first"))
    return rows.join(first, source).withColumn("history", F.col(poll) == F.col("_first")).drop("_first")
