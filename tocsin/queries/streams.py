"""Streaming queries, each over the event files at hand, and the binary point source."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators.sequences import cusum
from ..plans.tracks import flights, turnarounds
from ..session import shared_dir
from ..sources import firehose, heatmap
from ..streaming import corrections, state
from . import alarm_oracle, query, r6, with_


def work_folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/tocsin-{uuid.uuid4().hex}"


@query("stream_slot_counts", with_("e s", "SELECT slot, n FROM s WHERE (slot + 1800) * 1000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)"))
def stream_slot_counts(spark, sf_dir):
    s = state.window_counts(state.event_stream(spark, sf_dir), "ts")
    return state.run_to_table(s, work_folder(spark))


@query("stream_transitions", with_("e o tk", "SELECT hex, t, previous FROM tk"))
def stream_transitions(spark, sf_dir):
    e = state.event_stream(spark, sf_dir).select(F.col("user_id").alias("hex"), F.unix_seconds("ts").alias("t"), (~F.col("event_type").isin("signup", "error")).alias("airborne"), "event_id")
    return state.run_to_table(state.transition_stream(e, "hex", "t", "airborne", "event_id"), work_folder(spark))


@query("stream_cusum", alarm_oracle("e", "+ q AS (SELECT event_type AS series, t AS slot, event_id AS tie, (value - 40) / 20 AS z FROM e)"))
def stream_cusum(spark, sf_dir):
    e = state.event_stream(spark, sf_dir).select(F.col("event_type").alias("series"), F.unix_seconds("ts").alias("slot"), "event_id", ((F.col("value") - 40) / 20).alias("z"))
    return state.run_to_table(state.cusum_stream(e, "series", "slot", "z", "event_id"), work_folder(spark))


@query("stream_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_latest(spark, sf_dir):
    e = state.event_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    return state.upsert_stream(e, work_folder(spark), ["user_id"], ["event_id"])


def frames(spark, sf_dir):
    """Events as commits: a user's posts under three keys; an error deletes, a purchase edits."""
    e = A.events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "update").otherwise("create")
    return e.select(F.col("event_id").alias("seq"), "t", F.col("user_id").cast("string").alias("did"), (F.col("event_id") % 3).cast("string").alias("rkey"), kind.alias("operation"), F.concat_ws(" ", "event_type", "props").alias("text"))


FIREHOSE = with_("e", """+ f AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS did, CAST(event_id % 3 AS VARCHAR) AS rkey, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'update' ELSE 'create' END AS operation,
   CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || props END AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
 r AS (WITH RECURSIVE r(did, k, kept, seq, rkey, status, title, matched, hit) AS (SELECT DISTINCT did, CAST(0 AS BIGINT), CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), CAST(0 AS BIGINT), '', '', '', false, false FROM f
  UNION ALL SELECT did, k, CASE WHEN NOT hit THEN kept WHEN operation = 'delete' THEN rest ELSE CASE WHEN len(rest) >= 2 THEN rest[2:] ELSE rest END || [{'r': rkey, 't': title}] END,
   seq, rkey, CASE operation WHEN 'create' THEN 'current' WHEN 'update' THEN 'updated' ELSE 'cancelled' END, title, matched, hit
  FROM (SELECT *, CASE WHEN matched THEN body[:200] ELSE own[1].t END AS title, matched OR len(own) > 0 AS hit FROM (SELECT f.*, r.kept, regexp_matches(body, 'click|3') AS matched,
   list_filter(r.kept, lambda x: x.r = f.rkey) AS own, list_filter(r.kept, lambda x: x.r <> f.rkey) AS rest FROM r JOIN f ON f.did = r.did AND f.k = r.k + 1))) SELECT * FROM r WHERE hit)
 SELECT did, seq, rkey, status, title, matched FROM r""")


@query("firehose_corrections", FIREHOSE)
def firehose_corrections(spark, sf_dir):
    """Posts with a click or a 3 and their corrections, two kept for each user; two runs from one checkpoint, the first cut off halfway."""
    folder, f = work_folder(spark), frames(spark, sf_dir)
    f.repartitionByRange("seq").write.parquet(f"{folder}/log")
    spark.dataSource.register(firehose.Firehose)
    half = f.agg((F.count("*") / 2).cast("long").cast("string").alias("n")).first().n
    for bound in (half, "0"):
        stream = spark.readStream.format("firehose").option("path", f"{folder}/log").option("since", "0").option("maxFrames", bound).load()
        out = state.run_to_table(corrections.corrected_posts(stream, "click|3", cap=2), folder, rocks=True)
    return out


def point_files(spark, sf_dir) -> str:
    """Stations as moving points in binary files, one for each day of events, written by tasks."""
    folder = work_folder(spark)
    filesystem, base = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(base)
    e = A.observations(spark, sf_dir).select("hex", "t", "airborne", "v", F.floor(F.col("t") / 86400).alias("day"))

    def write(pdf):
        out, at = fs.FileSystem.from_uri(folder)
        p = pdf.assign(ms=pdf["t"] // 1800 * 1_800_000).sort_values(["ms", "t", "hex"], kind="stable")
        h, v, up = p["hex"].to_numpy(), p["v"].to_numpy(float), p["airborne"].to_numpy(bool)
        raw = heatmap.encode_columns(p["ms"].to_numpy(), h, (h * 37 % 140) - 70 + p["t"].to_numpy() % 1800 / 1e4, (h * 73 % 340) - 170.0, 25 * np.rint(v * 20), ~up, np.where(v < 400, np.rint(v), np.nan))
        cut = np.flatnonzero(np.frombuffer(raw, "<u4")[::4] == heatmap.MARKER)[1:] * 16
        sign = heatmap.encode([(0, [{"hex": "~0000aa", "squawk": 1200, "callsign": "TEST1"}])])[16:]  # one for each slice, at its end
        parts = [raw[a:b] + sign for a, b in zip([0, *cut], [*cut, len(raw)])]
        with out.open_output_stream(f"{at}/{pdf['day'].iloc[0]}.bin.ttf") as f:
            f.write(b"".join(parts))
        return pdf.iloc[:1][["day"]]

    e.groupBy("day").applyInPandas(write, "day long").count()
    return folder


HEATMAP = with_("e o", """+ h AS (SELECT format('{:06x}', hex) AS hex, t - t % 1800 AS slot, airborne, round_even(v * 20, 0) * 25 AS alt, CASE WHEN v < 400 THEN round_even(v, 0) END AS gs FROM o)
 SELECT hex, count(*) AS n, min(slot) * 1000 AS first_ms, max(slot) * 1000 AS last_ms, count(*) FILTER (NOT airborne) AS on_ground, min(alt) FILTER (airborne) AS lowest, max(alt) FILTER (airborne) AS highest, max(gs) AS fastest,
 CAST(NULL AS VARCHAR) AS callsign, CAST(NULL AS VARCHAR) AS squawk FROM h GROUP BY 1
 UNION ALL SELECT '~0000aa', count(DISTINCT slot), min(slot) * 1000, max(slot) * 1000, 0, NULL, NULL, NULL, 'TEST1', '1200' FROM h""")


@query("heatmap_decode", HEATMAP)
def heatmap_decode(spark, sf_dir):
    heatmap.register(spark)
    d = spark.read.format("heatmap").load(point_files(spark, sf_dir))
    return d.groupBy("hex").agg(
        F.count("*").alias("n"), F.min("slice_ms").alias("first_ms"), F.max("slice_ms").alias("last_ms"), F.count_if("on_ground").alias("on_ground"), F.min("alt_ft").alias("lowest"), F.max("alt_ft").alias("highest"),
        F.max("gs_kt").alias("fastest"), F.first("callsign", ignorenulls=True).alias("callsign"), F.first("squawk", ignorenulls=True).alias("squawk"),
    )


LATEST = with_("e o", """+ h AS (SELECT *, t - t % 1800 AS slot, CAST(t // 86400 AS VARCHAR) || '.bin.ttf' AS file, (hex * 37) % 140 - 70 + (t % 1800) / 1e4 AS lat FROM o)
 SELECT file, slot * 1000 AS slice_ms, format('{:06x}', hex) AS hex, round(lat, 6) AS lat, CASE WHEN airborne THEN round_even(v * 20, 0) * 25 END AS alt_ft, NOT airborne AS on_ground, CASE WHEN v < 400 THEN round_even(v, 0) END AS gs_kt
 FROM h WHERE slot = (SELECT max(slot) FROM h x WHERE x.file = h.file) AND lat BETWEEN -60 AND 60""")


@query("heatmap_latest", LATEST)
def heatmap_latest(spark, sf_dir):
    """The newest slice of each file, in a box."""
    heatmap.register(spark)
    d = spark.read.format("heatmap").option("latestOnly", "true").option("bbox", "-60,-170,60,170").load(point_files(spark, sf_dir))
    return d.filter("squawk is null").select("file", "slice_ms", "hex", r6("lat").alias("lat"), "alt_ft", "on_ground", "gs_kt")


#: Flights of four hours: an hour on the ground, then out and back, so far in degrees, climbing and descending by so many feet a second.
CYCLE, STAND, REACH, RATE = 14400, 3600, 4.0, 8


def fixes(spark, sf_dir):
    """hex, t, lat, lon, alt_ft, gs_kt, ground: events as fixes of three aircraft that fly out, turn and come back."""
    e = A.events(spark, sf_dir)
    hex_ = F.col("user_id") % 3
    e = e.groupBy(hex_.alias("hex"), "t").agg(F.max("value").alias("v")).withColumn("phase", F.pmod(F.col("t") + F.col("hex") * 3000, F.lit(CYCLE)))
    out, up = (CYCLE - STAND) / 2, F.col("phase") >= STAND
    away = F.when(up, 1 - F.abs(F.col("phase") - STAND - out) / out).otherwise(0.0)
    alt = F.when(up, F.least(F.lit(30000.0), RATE * (F.col("phase") - STAND), RATE * (CYCLE - F.col("phase")))).otherwise(0.0)
    gs = F.when(up, F.lit(160.0)).otherwise(F.lit(5.0))
    return e.select("hex", "t", (F.col("hex") * 10 + REACH * away).alias("lat"), (F.col("hex") * 10 + 2 * away).alias("lon"), alt.cast("double").alias("alt_ft"), gs.alias("gs_kt"), (~up & (F.col("v") < 50)).alias("ground"))


@query("track_flights")
def track_flights(spark, sf_dir):
    """Takeoffs and landings told from the fixes of aircraft."""
    return flights(fixes(spark, sf_dir))


@query("track_turnarounds", with_("e", f"""+ p AS (SELECT user_id % 3 AS hex, t, (t + user_id % 3 * 3000) % {CYCLE} AS phase FROM e GROUP BY 1, 2, 3),
 f AS (SELECT hex, t, hex * 10 + {REACH} * w AS lat, hex * 10 + 2.0 * w AS lon, CASE WHEN phase >= {STAND} THEN least(30000, {RATE} * (phase - {STAND}), {RATE} * ({CYCLE} - phase)) ELSE 0 END AS alt
   FROM (SELECT *, CASE WHEN phase >= {STAND} THEN 1 - abs(phase - {STAND} - {(CYCLE - STAND) / 2}) / {(CYCLE - STAND) / 2} ELSE 0 END AS w FROM p)),
 g AS (SELECT *, lag(t) OVER w AS t1, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lag(alt) OVER w AS alt1, lag(t, 2) OVER w AS t2, lag(lat, 2) OVER w AS lat2, lag(lon, 2) OVER w AS lon2, lag(alt, 2) OVER w AS alt2 FROM f WINDOW w AS (PARTITION BY hex ORDER BY t)),
 k AS (SELECT *, 12742 * asin(sqrt(least(1, pow(sin(radians(lat - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat)) * pow(sin(radians(lon - lon1) / 2), 2)))) AS d1, 12742 * asin(sqrt(least(1, pow(sin(radians(lat1 - lat2) / 2), 2) + cos(radians(lat2)) * cos(radians(lat1)) * pow(sin(radians(lon1 - lon2) / 2), 2)))) AS d2,
   degrees(atan2(sin(radians(lon - lon1)) * cos(radians(lat)), cos(radians(lat1)) * sin(radians(lat)) - sin(radians(lat1)) * cos(radians(lat)) * cos(radians(lon - lon1)))) AS b1, degrees(atan2(sin(radians(lon1 - lon2)) * cos(radians(lat1)), cos(radians(lat2)) * sin(radians(lat1)) - sin(radians(lat2)) * cos(radians(lat1)) * cos(radians(lon1 - lon2)))) AS b2
   FROM g WHERE t - t1 <= 1800 AND t1 - t2 <= 1800 AND least(alt, alt1, alt2) >= 10000)
 SELECT hex, t1 AS t, round(change, 6) AS change FROM (SELECT hex, t1, d1, d2, least(abs(b1 - b2), 360 - abs(b1 - b2)) AS change FROM k) WHERE d1 >= 2 AND d2 >= 2 AND change >= 120"""))
def track_turnarounds(spark, sf_dir):
    """Where the aircraft turn; fixes stand two kilometres apart or more."""
    return turnarounds(fixes(spark, sf_dir), least_km=2.0)


@query("stream_cusum_batch", with_("e", """+ f AS (SELECT event_type AS series, list_prepend(0.0::DOUBLE, list(greatest(-4.0, least(8.0, (value - 40) / 20)) - 1.5 ORDER BY t, event_id)) AS steps FROM e GROUP BY 1)
 SELECT series, round(max(list_reduce(steps[: k], lambda a, x: greatest(0.0, a + x))), 6) AS peak FROM f, unnest(range(1, len(steps) + 1)) u(k) GROUP BY 1"""))
def stream_cusum_batch(spark, sf_dir):
    """The batch twin of stream_cusum's sums, by closed form."""
    e = A.events(spark, sf_dir).select(F.col("event_type").alias("series"), F.col("t").alias("slot"), "event_id", ((F.col("value") - 40) / 20).alias("z"))
    return cusum(e, "series", ["slot", "event_id"], F.col("z"), 1.5).groupBy("series").agg(r6(F.max("s")).alias("peak"))
