"""The radiation detector over the generic tables: suppliers as stations in four towns, line items as their hourly readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.timeutil import unix
from ..plans import radiation
from . import query, r6
from .places import KM

#: A day of the tables is an hour here; the detector passes every six hours.
SQUEEZE, EVERY = 24, 21600
ORDER = ["t", "l_orderkey", "l_linenumber"]


def stations(spark, sf_dir):
    """source, station_id, name, lat, lon: each sixth instrument is a copy beside the one before; a fourth stands in a sparse network."""
    k = F.col("s_suppkey")
    m, g = F.floor(k / 4), k % 4
    p = F.when(m % 6 == 5, m - 1).otherwise(m)
    source = F.when(g == 3, "radnet").when(m % 2 == 1, "de").otherwise("eurdep")
    lat = 40 + 5 * g + 0.17 * (p % 9) + 0.0137 * F.floor(p / 9)
    return A.table(spark, sf_dir, "supplier").select(source.alias("source"), k.alias("station_id"), F.concat(F.lit("S"), p.cast("string")).alias("name"), lat.cast("double").alias("lat"), (10 + 0.21 * ((p * 5) % 7)).cast("double").alias("lon"))


def readings(spark, sf_dir, where):
    """source, station_id, t, value, normal: ordinary rates, and in some half days of each town many times as much."""
    i = A.table(spark, sf_dir, "lineitem").join(where.select("source", F.col("station_id").alias("l_suppkey")), "l_suppkey")
    k, t = F.col("l_suppkey"), F.floor(unix("l_shipdate") / SQUEEZE)
    surge = ((F.floor(t / 43200) + 7 * (k % 4)) % 9 == 0) & (k % 3 != 0)
    value = (80 + F.col("l_orderkey") % 40) / 1000.0 * F.when(surge, 6 + 20 * (k % 5)).otherwise(1)
    return i.select("source", k.alias("station_id"), t.alias("t"), "l_orderkey", "l_linenumber", value.alias("value"), (F.col("l_quantity") >= 2).alias("normal"))


#: The rule taken literally: every station at every pass, thinning and the budget one by one.
EVENTS = f"""WITH RECURSIVE s0 AS (SELECT s_suppkey AS k, s_suppkey // 4 AS m, s_suppkey % 4 AS g FROM supplier), s1 AS (SELECT *, CASE WHEN m % 6 = 5 THEN m - 1 ELSE m END AS p FROM s0),
 st AS (SELECT k AS id, CASE WHEN g = 3 THEN 'radnet' WHEN m % 2 = 1 THEN 'de' ELSE 'eurdep' END AS source, 'S' || p AS name, CAST(40 + 5 * g + 0.17::DOUBLE * (p % 9) + 0.0137::DOUBLE * (p // 9) AS DOUBLE) AS lat, 10 + 0.21::DOUBLE * ((p * 5) % 7) AS lon FROM s1),
 r0 AS (SELECT l_suppkey AS id, CAST(epoch(l_shipdate) AS BIGINT) // {SQUEEZE} AS t, l_orderkey AS ok, l_linenumber AS ln, l_quantity >= 2 AS normal FROM lineitem),
 rd AS (SELECT *, (80 + ok % 40) / 1000.0::DOUBLE * CASE WHEN (t // 43200 + 7 * (id % 4)) % 9 = 0 AND id % 3 <> 0 THEN 6 + 20 * (id % 5) ELSE 1 END AS v FROM r0),
 ps AS (SELECT DISTINCT t // {EVERY} * {EVERY} AS pass FROM rd),
 lt AS (SELECT pass, id, max_by(struct_pack(t := t, ok := ok, ln := ln, v := v, normal := normal), (t, ok, ln)) AS l FROM ps JOIN rd ON t BETWEEN pass - 10800 AND pass GROUP BY 1, 2),
 hs AS (SELECT pass, rd.id, rd.t, rd.ok, rd.ln, rd.v, rd.normal, l, rd.t = l.t AND rd.ok = l.ok AND rd.ln = l.ln AS newest FROM lt JOIN rd ON rd.id = lt.id AND rd.t BETWEEN pass - 2592000 AND pass AND (rd.t, rd.ok, rd.ln) <= (l.t, l.ok, l.ln) WHERE l.normal),
 md AS (SELECT pass, id, median(v) AS med FROM hs WHERE normal AND NOT newest GROUP BY 1, 2 HAVING count(*) >= 48),
 sg AS (SELECT pass, id, any_value(med) AS med, 1.4826 * median(abs(v - med)) AS mad FROM hs JOIN md USING (pass, id) WHERE normal AND NOT newest GROUP BY 1, 2),
 cd AS (SELECT pass, id, l.t AS t, l.v AS v, med, (l.v - med) / greatest(mad, 0.02, 0.05 * med) AS z, CASE WHEN med > 0 THEN l.v / med END AS ratio FROM lt JOIN sg USING (pass, id) WHERE (l.v >= 3 * med AND l.v - med >= 0.5) OR l.v >= 5),
 h2 AS (SELECT hs.*, med, NOT newest AND NOT (normal AND ((hs.v >= 3 * med AND hs.v - med >= 0.5) OR hs.v >= 5) AND lead(hs.t) OVER (PARTITION BY pass, id ORDER BY hs.t, hs.ok, hs.ln) - hs.t <= 5400) AS breaks FROM hs JOIN (SELECT pass, id, med FROM cd) USING (pass, id)),
 lb AS (SELECT pass, id, max((t, ok, ln)) AS b FROM h2 WHERE breaks GROUP BY 1, 2),
 rn AS (SELECT h2.pass, h2.id, count(*) AS hours, min(t) AS since FROM h2 LEFT JOIN lb ON lb.pass = h2.pass AND lb.id = h2.id WHERE b IS NULL OR (t, ok, ln) > b GROUP BY 1, 2),
 cn AS (SELECT cd.*, hours, since, source, name, lat, lon, row_number() OVER (PARTITION BY pass ORDER BY v DESC, id) AS k FROM cd JOIN rn USING (pass, id) JOIN st USING (id)),
 nb AS (SELECT a.pass, a.id, list(b.id) AS near FROM cn a JOIN cn b ON a.pass = b.pass AND a.id <> b.id WHERE {KM} < 1 GROUP BY 1, 2),
 th(pass, k, kept) AS (SELECT DISTINCT pass, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM cn UNION ALL SELECT th.pass, cn.k, CASE WHEN list_has_any(kept, coalesce(near, [])) OR len(kept) >= 200 THEN kept ELSE list_append(kept, cn.id) END FROM th JOIN cn ON cn.pass = th.pass AND cn.k = th.k + 1 LEFT JOIN nb ON nb.pass = cn.pass AND nb.id = cn.id),
 ds AS (SELECT cn.* FROM cn JOIN (SELECT pass, max_by(kept, k) AS kept FROM th GROUP BY 1) f ON f.pass = cn.pass AND list_contains(kept, cn.id)),
 ed AS (SELECT a.pass, a.id AS x, b.id AS y FROM ds a JOIN ds b ON a.pass = b.pass AND a.id <> b.id WHERE {KM} <= 50),
 rc(pass, id, hop) AS (SELECT pass, id, id FROM ds UNION SELECT rc.pass, rc.id, ed.y FROM rc JOIN ed ON rc.pass = ed.pass AND rc.hop = ed.x),
 gm AS (SELECT ds.*, c FROM ds JOIN (SELECT pass, id, min(hop) AS c FROM rc GROUP BY 1, 2) USING (pass, id)),
 ce AS (SELECT pass, c, sum(CAST(round(lat * 1e7) AS BIGINT)) / count(*) / 1e7 AS lat, sum(CAST(round(lon * 1e7) AS BIGINT)) / count(*) / 1e7 AS lon FROM gm GROUP BY 1, 2),
 gr AS (SELECT a.pass, a.c, count(*) AS n, count(DISTINCT a.name) AS names, min_by(a.id, (round({KM}, 6), a.k)) AS nearest, max(v) AS top, CASE WHEN bool_and(ratio IS NOT NULL) THEN median(ratio) END AS ratio, median(v - med) AS rise, bool_and(z >= 5) AS sharp,
   bool_and(source = 'radnet') AS sparse, max(hours) AS hours, max(t) AS observed, min(since) AS since, array_to_string(list_sort(list(DISTINCT source)), ',') AS networks, min(k) AS k, any_value(b.lat) AS lat, any_value(b.lon) AS lon FROM gm a JOIN ce b ON a.pass = b.pass AND a.c = b.c GROUP BY 1, 2),
 ev AS (SELECT *, sharp AND ratio >= 3 AND rise >= 0.5 AND CASE WHEN sparse THEN hours >= 2 OR n >= 2 ELSE n >= 3 AND names >= 2 END AS coherent, sharp AND ratio >= 3 AND rise >= 0.5 AS strong FROM gr),
 lv AS (SELECT *, CASE WHEN sparse THEN CASE WHEN NOT strong THEN 1 WHEN NOT coherent THEN 3 WHEN top >= 10 THEN 5 ELSE 4 END WHEN NOT coherent THEN 1 WHEN top >= 10 OR n >= 15 THEN 5 WHEN n >= 5 THEN 4 ELSE 3 END AS raw,
   format('radiation:{{:.2f}},{{:.2f}}:', lat, lon) || strftime(make_timestamp(CASE WHEN sparse THEN since ELSE observed END * 1000000), '%Y-%m-%dT%H') AS event_key FROM ev),
 sq AS (SELECT *, row_number() OVER (ORDER BY pass, k) AS i FROM lv),
 bg(i, keys, newest, level) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(-1000000 AS BIGINT), 0 UNION ALL
   SELECT i, CASE WHEN out >= 3 AND NOT known THEN list_append(keys, event_key) ELSE keys END, CASE WHEN out >= 3 AND NOT known THEN pass ELSE newest END, out FROM (SELECT *, CASE WHEN raw IN (3, 4) AND NOT known AND newest >= pass - 21600 THEN 1 ELSE raw END AS out
     FROM (SELECT sq.*, keys, newest, list_contains(keys, event_key) AS known FROM bg JOIN sq ON sq.i = bg.i + 1)))
 SELECT pass, event_key, bg.level, n, nearest, networks, hours, round(lat, 6) AS lat, round(lon, 6) AS lon, round(top, 6) AS top, round(ratio, 6) AS ratio, round(rise, 6) AS rise, coherent, raw >= 3 AND bg.level = 1 AS suppressed FROM sq JOIN bg USING (i)"""


@query("radiation_events", EVENTS)
def radiation_events(spark, sf_dir):
    where = stations(spark, sf_dir)
    r = readings(spark, sf_dir, where)
    passes = r.select((F.floor(F.col("t") / EVERY) * EVERY).alias("pass")).distinct()
    out = radiation.radiation_events(where, r, passes, ORDER, ["radnet"])
    return out.select("pass", "event_key", "level", "n", "nearest", "networks", "hours", *[r6(c).alias(c) for c in ("lat", "lon", "top", "ratio", "rise")], "coherent", "suppressed")
