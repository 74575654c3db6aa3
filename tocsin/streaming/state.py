"""Streams: windowed counts, keyed state, idempotent upserts. Each gives what its batch twin gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import CusumAlarm


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The files of that name as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, time: str, length: str = "30 minutes", late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """keys, slot, n of windows that the watermark has closed."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, length), *(keys or [])).agg(F.count("*").alias("n"))
    return g.select(*(keys or []), F.unix_seconds("window.start").alias("slot"), "n")


def cusum_stream(rows: DataFrame, key: str, time: str, z: str, tie: str | None = None) -> DataFrame:
    """Crossings as in sequences.cusum_crossings. A sample no later than the state's last one, by time and tie, is passed over, so a
    repeated batch changes nothing."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alarm = CusumAlarm(*(state.get if state.exists else ()))
        out = []
        for t, x, i in pd.concat(frames).sort_values([time, "_tie"])[[time, z, "_tie"]].itertuples(index=False, name=None):
            if severity := alarm.step(int(t), float(x), int(i)):
                out.append((k[0], int(t), severity, alarm.s))
        state.update((alarm.s, alarm.fired, alarm.last, alarm.tie))
        yield pd.DataFrame(out, columns=[key, time, "severity", "s"])

    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, time, z, (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} long, severity string, s double", "s double, fired int, last long, tie long", "append", GroupStateTimeout.NoTimeout)


def transition_stream(rows: DataFrame, key: str, time: str, flag: str, tie: str | None = None) -> DataFrame:
    """key, time, previous of rows that turn the flag on; the flag, time and tie of a key's last row are its state. Of rows of one time the
    larger tie is later; a row no later than the state's last one is passed over, so a repeated batch changes nothing."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, last, at = state.get if state.exists else (None, None, None)
        out = []
        for t, on, i in pd.concat(frames).sort_values([time, "_tie"], kind="stable")[[time, flag, "_tie"]].itertuples(index=False, name=None):
            if last is not None and (t < last or (tie and (t, i) <= (last, at))):
                continue
            if on and was is False:
                out.append((k[0], int(t), int(last)))
            was, last, at = bool(on), int(t), int(i)
        state.update((was, last, at))
        yield pd.DataFrame(out, columns=[key, time, "previous"])

    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, time, flag, (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} long, previous long", "was boolean, last long, tie long", "append", GroupStateTimeout.NoTimeout)


#: The setting of the state store, and the one that transformWithState needs.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, folder: str, rocks: bool = False) -> DataFrame:
    """Run what is there, exactly once, into a parquet table under folder, and read it; with rocks, its state lies in RocksDB."""
    conf = stream.sparkSession.conf
    was = conf.get(STORE)
    if rocks:
        conf.set(STORE, ROCKS)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(STORE, was)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], order: list[str]) -> DataFrame:
    """Run a stream into a table with the last row of each key. Every batch writes the next version beside the one before, so a batch that is
    run again overwrites only its own."""
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c not in keys]

    def batch(new: DataFrame, n: int) -> None:
        both = new if n == 0 else new.unionByName(new.sparkSession.read.schema(stream.schema).parquet(f"{folder}/v{n - 1}"))
        best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
        best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).write.mode("overwrite").parquet(f"{folder}/v{n}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{folder}/v{last['batchId'] if last else 0}")
