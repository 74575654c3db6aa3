"""The generic test tables, seen as the engine's own: slots, observations, stations, readings, alerts, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timeutil import half_hour_floor, unix
from .operators.sequences import transitions

HALF_HOUR = 1800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, t (seconds), user_id, event_type, value, props."""
    return table(spark, sf_dir, "events").withColumn("t", unix("ts"))


def slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot (its first second), n."""
    return events(spark, sf_dir).groupBy(half_hour_floor("t").alias("slot")).agg(F.count("*").alias("n"))


def slot_counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("series"), half_hour_floor("t").alias("slot")).agg(F.count("*").alias("n"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hex, t, event_id, airborne, v."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("hex"), "t", "event_id", (~F.col("event_type").isin("signup", "error")).alias("airborne"), F.col("value").alias("v"))


def takeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(observations(spark, sf_dir), "hex", ["t", "event_id"], "airborne")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, lat, lon, country."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    s = s.join(n, s.s_nationkey == n.n_nationkey)
    return s.select(
        F.col("s_suppkey").alias("station_id"), ((F.col("s_suppkey") * 37) % 140 - 70).cast("double").alias("lat"), ((F.col("s_suppkey") * 73) % 340 - 170).cast("double").alias("lon"), F.col("n_name").alias("country")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, t, value, reading_id (two keys)."""
    r = table(spark, sf_dir, "lineitem")
    return r.select(F.col("l_suppkey").alias("station_id"), unix("l_shipdate").alias("t"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), "l_orderkey", "l_linenumber")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_key, severity, cohort, t, status."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "elevated").otherwise("watch")
    return o.select(F.col("o_orderkey").alias("event_key"), severity.alias("severity"), (F.col("o_custkey") % 3).alias("cohort"), unix("o_orderdate").alias("t"), F.col("o_orderstatus").alias("status"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, external_id, turn, digest."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("role").alias("source_id"), F.col("conv_id").alias("external_id"), "turn", F.sha2("text", 256).alias("digest"))
