"""Groups of turns and departures over the generic tables: events as departures from four towns, some as turns in the air."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..plans import behaviour
from . import query, r6, with_
from .places import KM

STEP = 1800


def departures(spark, sf_dir):
    """hex, t, lat, lon: users from their towns, and in one hour of 37 from a single one."""
    e, u = A.events(spark, sf_dir), F.col("user_id")
    hour = F.floor(F.col("t") / 3600)
    town = F.when(hour % 37 == 5, F.floor(hour / 37) % 4).otherwise(u % 4)
    return e.select(F.format_string("%06x", "user_id").alias("hex"), "t", "event_type", (20 + 10 * town + 0.07 * (u % 11)).cast("double").alias("lat"), (5 + 0.09 * (u % 7)).cast("double").alias("lon"))


def instants(d):
    """Every half hour and every hour with an event."""
    slots = d.select((F.floor(F.col("t") / STEP) * STEP + STEP).alias("instant")).distinct()
    return slots, d.select(F.floor(F.col("t") / 3600).alias("hour")).distinct()


SEEN = """dp AS (SELECT format('{:06x}', user_id) AS hex, t, event_type, CAST(20 + 10 * CASE WHEN (t // 3600) % 37 = 5 THEN (t // 3600 // 37) % 4 ELSE user_id % 4 END + 0.07::DOUBLE * (user_id % 11) AS DOUBLE) AS lat, 5 + 0.09::DOUBLE * (user_id % 7) AS lon FROM e),
 cv AS (SELECT DISTINCT t // 3600 AS hour FROM dp), ins AS (SELECT DISTINCT t // 1800 * 1800 + 1800 AS instant FROM dp)"""
#: Windows of an hour at half hours: half of each of two hours, or one whole.
PAST = """hw AS (SELECT instant, ago, hour, (least(until, (hour + 1) * 3600) - greatest(until - 3600, hour * 3600)) / 3600.0::DOUBLE AS weight FROM (SELECT *, unnest(generate_series((until - 3600) // 3600, (until - 1) // 3600)) AS hour FROM (SELECT instant, ago, instant - ago * 86400 AS until FROM ins, range(1, 22) r(ago)))),
 ok AS (SELECT hw.instant, hw.ago FROM hw LEFT JOIN cv USING (hour) GROUP BY 1, 2 HAVING count(*) = count(cv.hour)), hr AS (SELECT hw.* FROM hw JOIN ok USING (instant, ago))"""


def groups(km: int, where: str = "true") -> str:
    return f"""ev AS (SELECT * FROM dp WHERE {where}), cp AS (SELECT instant, hex, arg_max(lat, (t, lat, lon)) AS lat, arg_max(lon, (t, lat, lon)) AS lon FROM ins JOIN ev ON t > instant - 3600 AND t <= instant GROUP BY 1, 2),
 ed AS (SELECT a.instant, a.hex AS x, b.hex AS y FROM cp a JOIN cp b ON a.instant = b.instant AND a.hex <> b.hex WHERE {KM} <= {km}),
 rc(instant, hex, hop) AS (SELECT instant, hex, hex FROM cp UNION SELECT rc.instant, rc.hex, ed.y FROM rc JOIN ed ON rc.instant = ed.instant AND rc.hop = ed.x),
 gm AS (SELECT cp.*, g FROM cp JOIN (SELECT instant, hex, min(hop) AS g FROM rc GROUP BY 1, 2) USING (instant, hex)),
 hx AS (SELECT t // 3600 AS hour, hex, arg_max(lat, (t, lat, lon)) AS lat, arg_max(lon, (t, lat, lon)) AS lon FROM ev GROUP BY 1, 2)"""


#: Errors, and in one hour of 29 views, are turns.
TURNED = "event_type = 'error' OR (event_type = 'view' AND (t // 3600) % 29 = 7)"
TURNS = with_("e", f"+ {SEEN}, {PAST}, {groups(200, TURNED)}, " + """sz AS (SELECT instant, max(n) AS n FROM (SELECT instant, g, count(*) AS n FROM gm GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 3),
 hc AS (SELECT hour, count(*) AS k FROM hx GROUP BY 1), ps AS (SELECT instant, ago, sum(coalesce(k, 0) * weight) AS x FROM hr LEFT JOIN hc USING (hour) GROUP BY 1, 2), bs AS (SELECT instant, count(*) AS days, median(x) AS med FROM ps GROUP BY 1 HAVING count(*) >= 10)
 SELECT instant, n, round(med, 6) AS median, days, CASE WHEN n >= 6 THEN 4 ELSE 3 END AS level FROM sz JOIN bs USING (instant) WHERE n >= 3 * med""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("turn_clusters", TURNS)
def turn_clusters(spark, sf_dir):
    d = departures(spark, sf_dir)
    slots, hours = instants(d)
    turned = (F.col("event_type") == "error") | ((F.col("event_type") == "view") & (F.floor(F.col("t") / 3600) % 29 == 7))
    return behaviour.turn_clusters(d.filter(turned), slots, hours).withColumn("median", r6("median"))


ORIGINS = with_("e", f"+ {SEEN}, {PAST}, {groups(60)}, " + f"""sz AS (SELECT instant, g, count(*) AS n, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z, list_sort(list(hex)) AS hexes FROM gm GROUP BY 1, 2 HAVING count(*) >= 6),
 pt AS (SELECT a.instant, a.g, b.hour, b.hex FROM (SELECT gm.* FROM gm JOIN sz USING (instant, g)) a JOIN (SELECT DISTINCT instant, hour FROM hr) h ON h.instant = a.instant JOIN hx b ON b.hour = h.hour WHERE {KM} <= 60 GROUP BY 1, 2, 3, 4),
 pc AS (SELECT instant, g, hour, count(*) AS k FROM pt GROUP BY 1, 2, 3), ps AS (SELECT sz.instant, sz.g, ago, sum(coalesce(k, 0) * weight) AS v FROM sz JOIN hr ON hr.instant = sz.instant LEFT JOIN pc ON pc.instant = sz.instant AND pc.g = sz.g AND pc.hour = hr.hour GROUP BY 1, 2, 3),
 bs AS (SELECT instant, g, count(*) AS days, median(v) AS med FROM ps GROUP BY 1, 2), lo AS (SELECT *, CASE WHEN n >= 2 * greatest(6, 3 * med) THEN 4 ELSE 3 END AS level FROM sz JOIN bs USING (instant, g) WHERE days >= 10 AND med >= 1 AND n >= 3 * med),
 sq AS (SELECT *, instant // 3600 * 3600 AS h, row_number() OVER (ORDER BY instant, g) AS i FROM lo),
 fo(i, h, open, event_key) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, l INTEGER, m VARCHAR[])[]), '' UNION ALL
  SELECT i, h, CASE WHEN hit IS NULL THEN list_append(was, struct_pack(k := own, l := level, m := hexes)) ELSE list_transform(was, lambda o: CASE WHEN o.k = hit AND o.l <= level THEN struct_pack(k := o.k, l := level, m := hexes) ELSE o END) END, coalesce(hit, own)
  FROM (SELECT *, list_filter(was, lambda o: list_has_any(o.m, hexes))[1].k AS hit, strftime(make_timestamp(h * 1000000), '%Y-%m-%dT%H') || ':' || hexes[1] AS own FROM (SELECT sq.*, CASE WHEN fo.h = sq.h THEN open ELSE [] END AS was FROM fo JOIN sq ON sq.i = fo.i + 1)))
 SELECT instant, event_key, level, n, round(med, 6) AS median, days, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon, array_to_string(hexes, ',') AS hexes FROM sq JOIN fo USING (i)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("origin_clusters", ORIGINS)
def origin_clusters(spark, sf_dir):
    d = departures(spark, sf_dir)
    slots, hours = instants(d)
    out = behaviour.origin_clusters(d, slots, hours)
    return out.select("instant", "event_key", "level", "n", r6("median").alias("median"), "days", r6("lat").alias("lat"), r6("lon").alias("lon"), F.array_join("hexes", ",").alias("hexes"))
