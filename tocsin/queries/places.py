"""Queries on stations and places: distances, components, density, grids, radiation-like readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.geo import grid_cell
from ..operators import graph, joins, records, tables
from ..plans import detectors
from . import query, r6, with_

KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query("station_pairs", with_("st", f"SELECT a.station_id AS a, b.station_id AS b, round({KM}, 6) AS km FROM st a JOIN st b ON a.station_id < b.station_id WHERE {KM} <= 1500"))
def station_pairs(spark, sf_dir):
    return joins.radius_pairs(A.stations(spark, sf_dir), "station_id", 1500.0).withColumn("km", r6("km"))


COMPONENTS = f"""WITH RECURSIVE st AS (SELECT s_suppkey AS station_id, CAST((s_suppkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((s_suppkey * 73) % 340 - 170 AS DOUBLE) AS lon FROM supplier),
 ed AS (SELECT a.station_id AS x, b.station_id AS y FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {KM} <= 1600),
 rc(id, hop) AS (SELECT station_id, station_id FROM st UNION SELECT rc.id, ed.y FROM rc JOIN ed ON rc.hop = ed.x) SELECT id AS station_id, min(hop) AS component FROM rc GROUP BY 1"""


@query("station_components", COMPONENTS)
def station_components(spark, sf_dir):
    return graph.radius_components(A.stations(spark, sf_dir), "station_id", 1600.0)


@query("dbscan_points", with_("st", f"""+ nb AS (SELECT a.station_id AS a, b.station_id AS b FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {KM} <= 1600),
 cr AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 3), ce AS (SELECT a, b FROM nb WHERE a IN (FROM cr) AND b IN (FROM cr)),
 rc AS (WITH RECURSIVE r(id, hop) AS (SELECT id, id FROM cr UNION SELECT r.id, ce.b FROM r JOIN ce ON r.hop = ce.a) SELECT id, min(hop) AS cluster FROM r GROUP BY 1),
 bd AS (SELECT nb.a AS id, min(cluster) AS near FROM nb JOIN rc ON nb.b = rc.id GROUP BY 1)
 SELECT station_id, CASE WHEN rc.id IS NOT NULL THEN 'core' WHEN near IS NOT NULL THEN 'border' ELSE 'noise' END AS role, coalesce(cluster, near, -1) AS cluster FROM st LEFT JOIN rc ON station_id = rc.id LEFT JOIN bd ON station_id = bd.id"""))
def dbscan_points(spark, sf_dir):
    return graph.dbscan(A.stations(spark, sf_dir), "station_id", 1600.0, 3).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


CLUSTERS = f"""WITH RECURSIVE st AS (SELECT s_suppkey AS station_id, CAST((s_suppkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((s_suppkey * 73) % 340 - 170 AS DOUBLE) AS lon FROM supplier),
 nb AS (SELECT a.station_id AS a, b.station_id AS b FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {KM} <= 1600),
 cr AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 3), rc(id, hop) AS (SELECT id, id FROM cr UNION SELECT rc.id, nb.b FROM rc JOIN nb ON rc.hop = nb.a JOIN cr ON cr.id = nb.b),
 co AS (SELECT id, min(hop) AS cluster FROM rc GROUP BY 1), mb AS (SELECT id, cluster FROM co UNION ALL SELECT nb.a, min(cluster) FROM nb JOIN co ON nb.b = co.id WHERE nb.a NOT IN (SELECT id FROM cr) GROUP BY 1),
 ce AS (SELECT cluster, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM mb JOIN st ON id = station_id GROUP BY 1),
 ds AS (SELECT b.cluster, a.station_id, {KM} AS km FROM mb JOIN st a ON mb.id = a.station_id JOIN ce b ON b.cluster = mb.cluster)
 SELECT cluster, n, round(lat, 6) AS lat, round(lon, 6) AS lon, (SELECT station_id FROM ds WHERE ds.cluster = ce.cluster ORDER BY km, station_id LIMIT 1) AS nearest FROM ce"""


@query("cluster_summary", CLUSTERS)
def cluster_summary(spark, sf_dir):
    s = A.stations(spark, sf_dir)
    c = graph.dbscan(s, "station_id", 1600.0, 3).filter("cluster is not null")
    out = graph.cluster_summary(c.join(s, "station_id"), "cluster", "station_id", "lat", "lon")
    return out.select("cluster", "n", r6("lat").alias("lat"), r6("lon").alias("lon"), "nearest")


#: The rule taken literally: station by station in the order of value, each kept unless one kept before is near.
SPREAD = f"""WITH RECURSIVE st AS (SELECT s_suppkey AS station_id, CAST((s_suppkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((s_suppkey * 73) % 340 - 170 AS DOUBLE) AS lon FROM supplier),
 nb AS (SELECT a.station_id AS id, list(b.station_id) AS near FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {KM} <= 1200 GROUP BY 1),
 od AS (SELECT station_id, coalesce(near, []) AS near, row_number() OVER (ORDER BY abs(lat) DESC, station_id) AS k FROM st LEFT JOIN nb ON id = station_id),
 rc(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT od.k, CASE WHEN list_has_any(rc.kept, od.near) THEN rc.kept ELSE list_append(rc.kept, od.station_id) END FROM rc JOIN od ON od.k = rc.k + 1)
 SELECT station_id, abs(lat) AS v FROM st WHERE list_contains((SELECT kept FROM rc ORDER BY k DESC LIMIT 1), station_id)"""


@query("spread_stations", SPREAD)
def spread_stations(spark, sf_dir):
    return graph.spread_first(A.stations(spark, sf_dir).withColumn("v", F.abs("lat")), "station_id", "v", 1200.0).select("station_id", "v")


@query("grid_presence_delta", """WITH p AS (SELECT CAST((s_suppkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((s_suppkey * 73) % 340 - 170 AS DOUBLE) AS lon, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
 g AS (SELECT CAST(floor(lat / (600 / 69.0)) AS BIGINT) AS r, m, lon FROM p), h AS (SELECT r, CAST(floor(lon / ((600 / 69.0) / greatest(cos(radians((r + 0.5) * (600 / 69.0))), 0.05))) AS BIGINT) AS c, m FROM g),
 n AS (SELECT r, c, m, count(*) AS n FROM h GROUP BY 1, 2, 3), z AS (SELECT max(m) - 1 AS now FROM h),
 k AS (SELECT DISTINCT r, c FROM n, z WHERE m BETWEEN now - 3 AND now), b AS (SELECT k.r, k.c, d.d, coalesce(n.n, 0) AS n FROM k CROSS JOIN (VALUES (1), (2), (3)) d(d) CROSS JOIN z LEFT JOIN n ON n.r = k.r AND n.c = k.c AND n.m = now - d.d),
 q AS (SELECT r, c, median(n) AS usual FROM b GROUP BY 1, 2), a AS (SELECT r, c, n FROM n, z WHERE m = now)
 SELECT q.r AS cell_row, q.c AS cell_col, CAST(coalesce(a.n, 0) AS DOUBLE) AS present, usual, coalesce(a.n, 0) - usual AS delta FROM q LEFT JOIN a ON a.r = q.r AND a.c = q.c""")
def grid_presence_delta(spark, sf_dir):
    """Rows of the last full month in each grid cell, against the median of the three months before, cells without rows counting 0."""
    r = A.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"))
    row, col = grid_cell("lat", "lon", 600.0)
    p = r.join(A.stations(spark, sf_dir), r.l_suppkey == F.col("station_id")).select(row.alias("cell_row"), col.alias("cell_col"), "m")
    n = p.groupBy("cell_row", "cell_col", "m").agg(F.count("*").alias("n")).crossJoin(F.broadcast(p.agg((F.max("m") - 1).alias("now"))))
    n = n.filter(F.col("m").between(F.col("now") - 3, F.col("now"))).withColumn("ago", F.col("now") - F.col("m"))
    past = [F.coalesce(F.sum(F.when(F.col("ago") == d, F.col("n"))), F.lit(0)).cast("double") for d in (1, 2, 3)]
    out = n.groupBy("cell_row", "cell_col").agg(F.coalesce(F.sum(F.when(F.col("ago") == 0, F.col("n"))), F.lit(0)).cast("double").alias("present"), F.array_sort(F.array(*past))[1].alias("usual"))
    return out.withColumn("delta", F.col("present") - F.col("usual"))


GRID = """WITH RECURSIVE g AS (SELECT CAST(floor(((s_suppkey * 37) % 140 - 70) / (600 / 69.0)) AS BIGINT) AS r, CAST((s_suppkey * 73) % 340 - 170 AS DOUBLE) AS lon FROM supplier),
 c AS (SELECT DISTINCT r, CAST(floor(lon / ((600 / 69.0) / greatest(cos(radians((r + 0.5) * (600 / 69.0))), 0.05))) AS BIGINT) AS c FROM g),
 rc(r, c, hr, hc) AS (SELECT r, c, r, c FROM c UNION SELECT rc.r, rc.c, c.r, c.c FROM rc JOIN c ON abs(c.r - rc.hr) <= 1 AND abs(c.c - rc.hc) <= 1)
 SELECT r AS cell_row, c AS cell_col, min({'r': hr, 'c': hc}).r || ':' || min({'r': hr, 'c': hc}).c AS component FROM rc GROUP BY 1, 2"""


@query("grid_components", GRID)
def grid_components(spark, sf_dir):
    row, col = grid_cell("lat", "lon", 600.0)
    return graph.grid_components(A.stations(spark, sf_dir).select(row.alias("cell_row"), col.alias("cell_col")), "cell_row", "cell_col")


NATIONS = "SELECT n_nationkey AS site_id, CAST((n_nationkey * 29) % 130 - 65 AS DOUBLE) AS lat, CAST((n_nationkey * 97) % 330 - 165 AS DOUBLE) AS lon FROM nation"


@query("nearest_site", with_("st", f"+ si AS ({NATIONS}), j AS (SELECT a.station_id, b.site_id, {KM} AS km FROM st a JOIN si b ON {KM} <= 2000) SELECT station_id, site_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, site_id) AS k FROM j) WHERE k = 1"))
def nearest_site(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    sites = n.select(F.col("n_nationkey").alias("site_id"), ((F.col("n_nationkey") * 29) % 130 - 65).cast("double").alias("site_lat"), ((F.col("n_nationkey") * 97) % 330 - 165).cast("double").alias("site_lon"))
    return joins.nearest_in_radius(A.stations(spark, sf_dir), sites, "station_id", "site_id", 2000.0).withColumn("km", r6("km"))


ORDER = ["t", "l_orderkey", "l_linenumber"]


@query("radiation_station_z", with_("rd", """+ k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY t DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM rd), l AS (SELECT station_id, t AS lt, value AS lv FROM k WHERE k = 1),
 p AS (SELECT k.station_id, value AS x, lt, lv FROM k JOIN l USING (station_id) WHERE k > 1 AND t >= lt - 400 * 86400), m AS (SELECT station_id, count(*) AS n, median(x) AS med FROM p GROUP BY 1 HAVING count(*) >= 48),
 b AS (SELECT station_id, any_value(lt) AS t, any_value(lv) AS value, any_value(n) AS n, any_value(med) AS med, 1.4826 * median(abs(x - med)) AS mad FROM p JOIN m USING (station_id) GROUP BY 1)
 SELECT station_id, t, round(value, 9) AS value, n, round(med, 9) AS med, round((value - med) / greatest(mad, 0.02, 0.05 * med), 6) AS z, (value >= 3 * med AND value - med >= 0.5) OR value >= 5 * med AS departing FROM b"""))
def radiation_station_z(spark, sf_dir):
    out = detectors.station_scores(A.readings(spark, sf_dir), ORDER, days=400)
    return out.select("station_id", "t", F.round("value", 9).alias("value"), "n", F.round("med", 9).alias("med"), r6("z").alias("z"), "departing")


@query("departing_runs", with_("rd", """+ m AS (SELECT station_id, median(value) AS med FROM rd GROUP BY 1), f AS (SELECT rd.*, value > 1.3 * med AS dep FROM rd JOIN m USING (station_id)),
 g AS (SELECT *, sum(CASE WHEN dep THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY t, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS run FROM f), r AS (SELECT station_id, run, sum(CASE WHEN dep THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1, 2)
 SELECT station_id, count(*) FILTER (n > 0) AS runs, CAST(max(n) AS BIGINT) AS longest FROM r GROUP BY 1"""))
def departing_runs(spark, sf_dir):
    return detectors.departing_runs(A.readings(spark, sf_dir), ORDER)


QUAKES = """qk AS (SELECT station_id AS quake_id, lat, lon, CASE WHEN station_id % 11 = 0 THEN NULL ELSE CAST(station_id % 13 AS DOUBLE) END AS depth, CAST(station_id % 7 AS DOUBLE) AS magnitude, CASE station_id % 9 WHEN 0 THEN 'explosion' WHEN 1 THEN 'nuclear explosion' WHEN 2 THEN 'quarry blast' ELSE 'earthquake' END AS kind FROM st),
 si AS (SELECT n_nationkey AS site_id, CAST((n_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((n_nationkey * 73) % 340 - 170 AS DOUBLE) AS lon, CAST(300 + n_nationkey * 20 AS DOUBLE) AS radius, n_nationkey % 2 = 0 AS quiet FROM nation)"""


@query("seismic_verdict", with_("st", f"""+ {QUAKES}, j AS (SELECT a.quake_id, b.site_id, quiet, {KM} AS km FROM qk a JOIN si b ON {KM} <= radius), nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quake_id ORDER BY km, site_id) AS k FROM j) WHERE k = 1),
 v AS (SELECT qk.*, site_id, km, quiet, coalesce(kind IN ('earthquake', 'explosion', 'collapse', 'other event') AND site_id IS NOT NULL AND magnitude >= 3.5, false) AS here, coalesce(depth <= 5, false) AS shallow, depth IS NULL OR depth = 10 AS unknown FROM qk LEFT JOIN nr USING (quake_id)),
 o AS (SELECT *, CAST(CASE WHEN kind = 'nuclear explosion' THEN 5 WHEN here THEN CASE WHEN kind = 'explosion' OR shallow THEN 4 WHEN unknown THEN CASE WHEN quiet THEN 4 ELSE 3 END ELSE 1 END WHEN kind = 'explosion' AND magnitude >= 4 THEN 3 END AS INTEGER) AS level FROM v)
 SELECT quake_id, CASE WHEN here OR level = 5 THEN site_id END AS site_id, CASE WHEN here OR level = 5 THEN round(km, 6) END AS km, level, CASE WHEN level = 5 THEN 'agency_classified_nuclear' WHEN here THEN 'test_site_geofence' ELSE 'agency_classified_explosion' END AS rule,
 CASE WHEN level = 5 OR NOT here THEN 'as reported' WHEN shallow THEN 'shallow' WHEN unknown THEN 'unconstrained' ELSE 'deep' END AS "constraint" FROM o WHERE level IS NOT NULL"""))
def seismic_verdict(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    sites = n.select(key.alias("site_id"), ((key * 37) % 140 - 70).cast("double").alias("site_lat"), ((key * 73) % 340 - 170).cast("double").alias("site_lon"), (300 + key * 20).cast("double").alias("radius_km"), (key % 2 == 0).alias("quiet"))
    i = F.col("station_id")
    kind = F.when(i % 9 == 0, "explosion").when(i % 9 == 1, "nuclear explosion").when(i % 9 == 2, "quarry blast").otherwise("earthquake")
    q = A.stations(spark, sf_dir).select(i.alias("quake_id"), "lat", "lon", F.when(i % 11 != 0, (i % 13).cast("double")).alias("depth"), (i % 7).cast("double").alias("magnitude"), kind.alias("classification"))
    return detectors.seismic_verdict(q, sites, 800.0).select("quake_id", "site_id", r6("km").alias("km"), "level", "rule", "constraint")


def cell_share(name: str, sign: str) -> str:
    up = f"SELECT r, c, {sign}d AS d FROM dl WHERE {sign}d > 0"
    return f"""{name} AS (SELECT coalesce(max(d) / sum(d), 0) AS cell, coalesce((SELECT max(t) FROM (SELECT sum(b.d) AS t FROM ({up}) a JOIN ({up}) b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c)) / sum(d), 0) AS near FROM ({up}))"""


@query("excess_pattern", f"""WITH sh AS (SELECT s_nationkey AS k, count(*) / (SELECT count(*) FROM supplier) AS x FROM supplier GROUP BY 1), ch AS (SELECT c_nationkey AS k, count(*) / (SELECT count(*) FROM customer) AS x FROM customer GROUP BY 1),
 dl AS (SELECT n_nationkey // 5 AS r, n_nationkey % 5 AS c, coalesce(sh.x, 0) - coalesce(ch.x, 0) AS d FROM nation LEFT JOIN sh ON sh.k = n_nationkey LEFT JOIN ch ON ch.k = n_nationkey), {cell_share('u', '')}, {cell_share('w', '-')}
 SELECT round(u.cell, 6) AS departure_cell, round(u.near, 6) AS departure_near, round(w.cell, 6) AS arrival_cell, round(w.near, 6) AS arrival_near,
  CASE WHEN u.near >= 0.30 OR u.cell >= 0.18 THEN 'specific departure anchor' WHEN w.near >= 0.30 OR w.cell >= 0.18 THEN 'specific arrival anchor' WHEN u.near >= 0.16 AND u.near >= w.near THEN 'regional departure concentration' WHEN w.near >= 0.16 THEN 'regional arrival concentration' ELSE 'diffuse national redistribution' END AS label FROM u, w""")
def excess_pattern(spark, sf_dir):
    """Nations as grid cells: suppliers' shares over customers' as departures, the other way round as arrivals."""
    share = lambda t, k: A.table(spark, sf_dir, t).groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(A.table(spark, sf_dir, t).agg(F.count("*").alias("all")))).select("k", (F.col("n") / F.col("all")).alias(t))
    d = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).join(share("supplier", "s_nationkey"), "k", "left").join(share("customer", "c_nationkey"), "k", "left")
    d = d.select(F.floor(F.col("k") / 5).alias("r"), (F.col("k") % 5).alias("c"), (F.coalesce("supplier", F.lit(0.0)) - F.coalesce("customer", F.lit(0.0))).alias("delta"))
    named = lambda df, name: df.select(F.col("cell_share").alias(f"{name}_cell"), F.col("near_share").alias(f"{name}_near"))
    up, down = named(records.concentration(d, "r", "c"), "departure"), named(records.concentration(d.withColumn("delta", -F.col("delta")), "r", "c"), "arrival")
    none = F.lit(0.0)
    label = records.pattern_label(none, none, F.col("departure_near"), F.col("arrival_near"), F.col("departure_cell"), F.col("arrival_cell"))
    return up.crossJoin(F.broadcast(down)).select(*[r6(f"{a}_{b}").alias(f"{a}_{b}") for a in ("departure", "arrival") for b in ("cell", "near")], label.alias("label"))


@query("country_deltas", "SELECT n_name AS country, CAST(coalesce(a.n, 0) AS BIGINT) AS suppliers, CAST(coalesce(b.n, 0) AS BIGINT) AS customers, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS delta FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON b.k = n_nationkey WHERE a.n IS NOT NULL OR b.n IS NOT NULL")
def country_deltas(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    a = A.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    b = A.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return tables.merge_counts(a, b, ["n_nationkey"], "suppliers", "customers").join(n, "n_nationkey").drop("n_nationkey")
