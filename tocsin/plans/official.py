"""The state of official notices at any instant: what a message says of its own time, and what later messages of its sender say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_intervals(messages: DataFrame, listed: str | None = None) -> DataFrame:
    """message_id, status, since, until (seconds, exclusive; null: still so) of messages (as of cap_messages, the actual ones), without gaps
    from the sending on.

    A message is cancelled from the first Cancel on that names its sender, id and time of sending, and superseded from the first such
    Update on; controls sent before it are void. A valid Cancel is cancelled itself. Else it is expired from its expiry or end on,
    upcoming until it begins and then active, but unverified where its timing isn't valid; with `listed` (a column: seconds until which
    the source listed it), it is unverified after that while it would be live.
    """
    m = messages.filter("actual AND sent IS NOT NULL").select("message_id", "sender", "message_type", "sent", "effective", F.least("expires", F.coalesce("ends", "expires")).alias("over"), "timing_valid", "references", (F.col(listed) if listed else F.lit(None).cast("long")).alias("listed"))
    c = m.filter(F.col("message_type").isin("Cancel", "Update")).select("message_type", F.col("sent").alias("told"), F.explode("references").alias("r")).select("message_type", "told", F.col("r.sender").alias("sender"), F.col("r.identifier").alias("message_id"), F.col("r.sent").alias("sent"))
    first = lambda kind: F.min(F.when(F.col("message_type") == kind, F.col("told")))
    c = c.filter("told >= sent").groupBy("sender", "message_id", "sent").agg(first("Cancel").alias("cancelled"), first("Update").alias("superseded"))
    m = m.join(c, ["sender", "message_id", "sent"], "left")
    own = (F.col("message_type") == "Cancel") & F.col("timing_valid") & ~F.exists("references", lambda r: r.sent > F.col("sent"))
    m = m.withColumn("cancelled", F.when(own, F.col("sent")).otherwise(F.col("cancelled")))
    reached = lambda c, t: F.coalesce(t >= F.col(c), F.lit(False))
    valid = F.col("timing_valid") & (F.col("message_type") != "Cancel")

    def at(t: Column) -> Column:
        live = F.when(reached("effective", t), "active").otherwise("upcoming")
        gone = F.coalesce(t > F.col("listed"), F.lit(True)) if listed else F.lit(False)
        timed = F.when(reached("over", t), "expired").when(gone | ~F.col("message_type").isin("Alert", "Update"), "unverified").otherwise(live)
        return F.when(reached("cancelled", t), "cancelled").when(reached("superseded", t), "superseded").when(valid, timed).otherwise("unverified")

    moments = F.array_sort(F.array_distinct(F.filter(F.array("sent", "effective", "over", "cancelled", "superseded", F.col("listed") + 1), lambda t: t >= F.col("sent"))))
    steps = m.select("message_id", F.explode(F.transform(moments, lambda t: F.struct(t.alias("since"), at(t).alias("status")))).alias("s")).select("message_id", "s.*")
    w = Window.partitionBy("message_id").orderBy("since")
    steps = steps.withColumn("_same", F.col("status").eqNullSafe(F.lag("status").over(w))).filter("NOT _same")
    return steps.select("message_id", "status", "since", F.lead("since").over(w).alias("until"))


def status_at(intervals: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """message_id, t, status at each of the instants start, start + step, ... up to end: every interval gives those that it holds."""
    lo = F.lit(start) + F.greatest(F.lit(0), F.ceil((F.col("since") - start) / step)).cast("long") * step
    hi = F.least(F.lit(end), F.coalesce(F.col("until") - 1, F.lit(end)))
    return intervals.filter(lo <= hi).select("message_id", F.explode(F.sequence(lo, hi, F.lit(step).cast("long"))).alias("t"), "status")


def status_counts(intervals: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """t, status, n of the same instants, from what begins and ends between two of them; no row for each message and instant is made."""
    slot = lambda c: F.lit(start) + F.greatest(F.lit(0), F.ceil((F.col(c) - start) / step)).cast("long") * step
    change = intervals.select("status", slot("since").alias("t"), F.lit(1).alias("d")).unionAll(intervals.filter("until IS NOT NULL").select("status", slot("until"), F.lit(-1)))
    change = change.filter(F.col("t") <= end).groupBy("status", "t").agg(F.sum("d").alias("d"))
    grid = intervals.sparkSession.range(start, end + 1, step).select(F.col("id").alias("t"))
    every = grid.join(F.broadcast(intervals.sparkSession.createDataFrame([(s,) for s in ("active", "upcoming", "unverified", "cancelled", "superseded", "expired")], "status string")))  # six statuses
    so_far = Window.partitionBy("status").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(change, ["status", "t"], "left").select("t", "status", F.coalesce(F.sum("d").over(so_far), F.lit(0)).alias("n")).filter("n > 0")
