"""Event windows over the generic tables: suppliers as events of three days somewhere in the years of orders, nations as cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.timeutil import DAY, day_of
from ..plans import detectors, windows
from . import query, r6
from .places import KM

MILES = KM.replace("6371.0", "3958.7613")
WINDOWS = f"""WITH o AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 86400 AS slot, c_nationkey AS cell FROM orders JOIN customer ON o_custkey = c_custkey), lo AS (SELECT min(slot) AS t0 FROM o), sl AS (SELECT slot, count(*) AS n FROM o GROUP BY 1), pr AS (SELECT slot, cell, count(*) AS n FROM o GROUP BY 1, 2),
 xj AS (SELECT a.slot, a.n, CAST(b.n AS DOUBLE) AS x FROM sl a JOIN sl b ON a.slot % 604800 = b.slot % 604800 AND abs(a.slot - b.slot) BETWEEN 864000 AND 15724800), rs AS (SELECT slot, any_value(n) - median(x) AS r FROM xj GROUP BY 1 HAVING count(*) >= 8),
 ew AS (SELECT s_suppkey AS key, s_nationkey AS nk, t0 + (s_suppkey * 83) % 2000 * 86400 AS s FROM supplier, lo), w AS (SELECT key, week, s + week * 604800 AS s FROM ew, (SELECT unnest([0, -12, -10, -8, -6, -4, 4, 6, 8, 10, 12]) AS week)),
 sc AS (SELECT key, week, count(*) AS samples, sum(r) AS total, sum(abs(r)) AS absolute, max(r) AS peak FROM w JOIN rs ON slot >= s AND slot < s + 259200 GROUP BY 1, 2),
 ch AS (SELECT key, week FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(total), absolute, week) AS k FROM sc WHERE week <> 0) WHERE k <= 4), nc AS (SELECT key, count(*) AS k FROM ch GROUP BY 1),
 st AS (SELECT key, samples, total, peak, (SELECT count(*) + 1 FROM sc b WHERE b.key = a.key AND b.total > a.total) AS place, (SELECT count(*) FROM sc b WHERE b.key = a.key) AS c FROM sc a WHERE week = 0),
 nw AS (SELECT key, cell, sum(n) AS n FROM w JOIN pr ON slot >= s AND slot < s + 259200 WHERE week = 0 GROUP BY 1, 2), th AS (SELECT key, cell, sum(n) AS n FROM w JOIN ch USING (key, week) JOIN pr ON slot >= s AND slot < s + 259200 GROUP BY 1, 2),
 dl AS (SELECT nw.key, nw.cell, nw.n - coalesce(th.n, 0) / k AS d FROM nw LEFT JOIN th ON th.key = nw.key AND th.cell = nw.cell JOIN nc ON nc.key = nw.key), tp AS (SELECT key, arg_min(cell, (-round(d, 9), cell)) AS cell, max(d) / sum(d) AS share FROM dl WHERE d > 0 GROUP BY 1),
 np AS (SELECT n_nationkey AS k, CAST((n_nationkey * 7) % 20 + 30 AS DOUBLE) AS lat, CAST((n_nationkey * 3) % 14 AS DOUBLE) AS lon FROM nation),
 mt AS (SELECT st.*, tp.cell, share, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN {MILES} END AS miles FROM st JOIN ew ON ew.key = st.key LEFT JOIN tp ON tp.key = st.key LEFT JOIN np a ON a.k = CASE WHEN ew.key % 5 <> 0 THEN nk END LEFT JOIN np b ON b.k = tp.cell),
 mm AS (SELECT *, CASE WHEN miles IS NOT NULL THEN greatest(0, least(1, (350 - miles) / 250)) END AS m, coalesce(share, 0) AS sh FROM mt)
 SELECT key, samples, round(total, 6) AS total, round(peak, 6) AS peak, CAST(place AS INTEGER) AS place, c AS "of", cell, round(share, 6) AS share, round(miles, 6) AS miles, round(m, 6) AS "match",
 CASE WHEN m IS NULL THEN CASE WHEN sh >= 0.25 THEN 'one gateway' WHEN sh >= 0.14 THEN 'a region of gateways' ELSE 'no gateway' END WHEN m >= 0.75 AND sh >= 0.18 THEN 'strong match' WHEN m >= 0.45 AND sh >= 0.14 THEN 'regional match' WHEN sh >= 0.20 THEN 'elsewhere' ELSE 'weak' END AS label FROM mm"""


@query("event_windows", WINDOWS)
def event_windows(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    presence = A.table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy((day_of(F.unix_timestamp("o_orderdate")) * DAY).alias("slot"), "cell").agg(F.count("*").alias("n"))
    days = presence.groupBy("slot").agg(F.sum("n").alias("n"))
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")
    lat, lon = (nation * 7 % 20 + 30).cast("double"), (nation * 3 % 14).cast("double")
    start = F.timestamp_seconds(F.col("t0") + key * 83 % 2000 * DAY)
    s = A.table(spark, sf_dir, "supplier").crossJoin(F.broadcast(days.agg(F.min("slot").alias("t0"))))
    w = s.select(key.alias("key"), start.alias("local_start"), (start + F.make_dt_interval(F.lit(3))).alias("local_end"), F.lit("UTC").alias("tz"))
    n = A.table(spark, sf_dir, "nation")
    places = s.filter(key % 5 != 0).select(key.alias("key"), F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey").select("key", lat.alias("lat"), lon.alias("lon"))
    cells = n.select(nation.alias("cell"), lat.alias("cell_lat"), lon.alias("cell_lon"))
    out = windows.validated(w, places, detectors.excess_origins(days), presence, cells, DAY)
    return out.select("key", "samples", *[r6(x).alias(x) for x in ("total", "peak", "share", "miles", "match")], "place", "of", "cell", "label")
