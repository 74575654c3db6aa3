"""Queries that pick, unite and lay out rows: pages, tops, JSON groups, associations, phases, point summaries, small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import geo, stats, timeutil
from ..operators import graph, sequences, tables
from ..plans import points
from . import query, r6, with_
from .notices import NOW
from .records import lineage


@query("filter_if_given", with_("e", "SELECT event_id, coalesce(CASE WHEN value > 90 THEN 'high' END, CASE WHEN user_id % 2 = 0 THEN 'even' END, event_type) AS label FROM e WHERE event_type = 'click'"))
def filter_if_given(spark, sf_dir):
    label = F.coalesce(F.when(F.col("value") > 90, "high"), F.when(F.col("user_id") % 2 == 0, "even"), F.col("event_type"))
    return tables.optional_filters(A.events(spark, sf_dir), event_type="click", user_id=None).select("event_id", label.alias("label"))


@query("rolling_retention", with_("e", f"SELECT event_id, t FROM e WHERE t >= {NOW} - 259200"))
def rolling_retention(spark, sf_dir):
    return tables.retained(A.events(spark, sf_dir).select("event_id", "t"), "t", NOW, 259200)


@query("json_between", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 20 AND 40")
def json_between(spark, sf_dir):
    return A.events(spark, sf_dir).filter(F.get_json_object("props", "$.k").cast("long").between(20, 40)).select("event_id")


@query("json_groups", "SELECT l_orderkey, '[' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) || ']' AS lines FROM lineitem GROUP BY 1")
def json_groups(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("lines"))


@query("json_lateral", "SELECT l_linenumber AS number, count(*) AS n FROM lineitem GROUP BY 1")
def json_lateral(spark, sf_dir):
    """The JSON lists of json_groups joined back, an element a row."""
    return json_groups(spark, sf_dir).select(F.explode(F.from_json("lines", "array<int>")).alias("number")).groupBy("number").agg(F.count("*").alias("n"))


@query("strongest_associations", "SELECT c.conv_id || ':' || c.turn AS node, d.role AS topic, bool_or(length(d.text) % 3 = 0) AS \"primary\" FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn <= c.turn GROUP BY 1, 2")
def strongest_associations(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    links = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"), F.col("role").alias("topic"), (F.length("text") % 3 == 0).alias("primary"))
    return graph.strongest_associations(graph.ancestors(lineage(spark, sf_dir), "successor", "predecessor").select("node", "ancestor"), links)


@query("zip_alignment", "WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders), b AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS place FROM orders) SELECT o_custkey, place, o_orderkey AS keys, o_totalprice AS totals FROM a JOIN b USING (o_custkey, place)")
def zip_alignment(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.array_sort(F.collect_list("o_totalprice")).alias("totals"))
    return tables.zipped(o, "o_custkey", "keys", "totals")


@query("busiest_hour", with_("e", "SELECT t // 3600 % 24 AS hour, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, hour LIMIT 1"))
def busiest_hour(spark, sf_dir):
    return tables.top_counts(A.events(spark, sf_dir), F.floor(F.col("t") / 3600) % 24, 1, "hour")


@query("batch_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def batch_after(spark, sf_dir):
    return tables.batch_after(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 50)


@query("overflow_probe", "SELECT l_orderkey FROM lineitem ORDER BY l_orderkey OFFSET 2000 LIMIT 1")
def overflow_probe(spark, sf_dir):
    """The row after a full page of 2,000: where there is one, the page is not whole."""
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey").orderBy("l_orderkey").offset(2000).limit(1)


@query("top_of_tops", with_("al", "SELECT event_key, cohort, t FROM al ORDER BY t DESC, event_key LIMIT 10"))
def top_of_tops(spark, sf_dir):
    a = A.alerts(spark, sf_dir).select("event_key", "cohort", "t")
    return tables.top_of_tops([a.filter(F.col("cohort") == c) for c in range(3)], [F.desc("t"), F.asc("event_key")], 10)


@query("candidate_union", with_("al", "SELECT event_key, severity FROM al WHERE severity IN ('high', 'critical') OR status = 'O'"))
def candidate_union(spark, sf_dir):
    a = A.alerts(spark, sf_dir)
    return a.filter("severity in ('high', 'critical')").union(a.filter("status = 'O'")).dropDuplicates(["event_key"]).select("event_key", "severity")


@query("mixed_records", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS total, CAST(NULL AS DOUBLE) AS balance FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer")
def mixed_records(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    return o.unionByName(A.table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), allowMissingColumns=True)


@query("alert_messages", with_("al", "SELECT printf('%s: %d alerts of cohort %d, the last at %d', severity, count(*), cohort, max(t)) AS message FROM al GROUP BY severity, cohort"))
def alert_messages(spark, sf_dir):
    a = A.alerts(spark, sf_dir).groupBy("severity", "cohort").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    return a.select(F.format_string("%s: %d alerts of cohort %d, the last at %d", "severity", "n", "cohort", "last").alias("message"))


@query("baseline_enrolment", with_("e", "SELECT event_id, t // 86400 = min(t // 86400) OVER (PARTITION BY user_id) AS history FROM e"))
def baseline_enrolment(spark, sf_dir):
    """Each user is a source that is polled daily."""
    return tables.enrolled(A.events(spark, sf_dir).select("event_id", "user_id", F.floor(F.col("t") / 86400).alias("poll")), "user_id", "poll").select("event_id", "history")


@query("phase_runs", with_("e", """+ x AS (SELECT user_id, t, event_id, event_type, coalesce(event_type <> lag(event_type) OVER w, true) AS new FROM e WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 r AS (SELECT *, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM x) SELECT user_id, run, event_type AS phase, count(*) AS n, min(t) AS first FROM r GROUP BY 1, 2, 3"""))
def phase_runs(spark, sf_dir):
    e = A.events(spark, sf_dir).withColumnRenamed("event_type", "phase")
    return sequences.phase_runs(e, "user_id", ["t", "event_id"], "phase", "error")


@query("cusum_stretches", with_("e", """+ c AS (SELECT event_type AS series, t - t % 1800 AS slot, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY series ORDER BY slot) <= 1800 THEN 0 ELSE 1 END AS new FROM c),
 i AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING) AS stretch, greatest(-4.0, least(8.0, n - 1.25)) - 0.5 AS step FROM g), s AS (SELECT *, CAST(sum(step) OVER (PARTITION BY series, stretch ORDER BY slot ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS c FROM i)
 SELECT series, slot, round(c - least(0.0, min(c) OVER (PARTITION BY series, stretch ORDER BY slot ROWS UNBOUNDED PRECEDING)), 6) AS s FROM s"""))
def cusum_stretches(spark, sf_dir):
    c = A.slot_counts_by(spark, sf_dir)
    return sequences.cusum_stretches(c, "series", "slot", F.col("n") - 1.25, 0.5, 1800).select("series", "slot", r6("s").alias("s"))


@query("strict_offsets", "SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 1 AND c_custkey % 31 < 29 THEN 1706745600 + 86400 * (c_custkey % 31) - CASE WHEN c_nationkey % 3 = 2 THEN 7200 ELSE 0 END END AS t FROM customer")
def strict_offsets(spark, sf_dir):
    """Days of February, some of which do not exist, with and without an offset."""
    zone = F.element_at(F.array(F.lit("Z"), F.lit(""), F.lit("+02:00")), F.col("c_nationkey") % 3 + 1)
    text = F.concat(F.format_string("2024-02-%02dT00:00:00", F.col("c_custkey") % 31 + 1), zone)
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.unix_seconds(timeutil.strict_offset_timestamp(text)).alias("t"))


@query("group_means", with_("e", """SELECT event_type, round(avg(value), 6) AS mean, round(sum(value * (user_id % 3)) / sum(user_id % 3), 6) AS weighted, list_sort(list(value))[CAST(greatest(1, ceil(0.9 * count(value))) AS BIGINT)] AS ninetieth,
 round(sqrt(sum(exp(-ln(2) / 7 * (t - 1704067200) / 86400.0) * value * value) / sum(exp(-ln(2) / 7 * (t - 1704067200) / 86400.0))), 6) AS rms, floor(avg(-value) * 10 + 0.5) / 10 AS half_up FROM e GROUP BY 1"""))
def group_means(spark, sf_dir):
    age = (F.col("t") - 1704067200) / 86400.0
    return A.events(spark, sf_dir).groupBy("event_type").agg(
        r6(stats.finite_mean("value")).alias("mean"), r6(stats.weighted_mean("value", F.col("user_id") % 3)).alias("weighted"), stats.nearest_rank("value", 0.9).alias("ninetieth"),
        r6(stats.decayed_rms("value", age, 7.0)).alias("rms"), stats.round_half_up(F.avg(-F.col("value")), 1).alias("half_up"),
    )


@query("bearings", with_("st", """+ b AS (SELECT station_id, degrees(atan2(sin(radians(20 - lon)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(20 - lon)))) AS d FROM st),
 c AS (SELECT station_id, CASE WHEN d < 0 THEN d + 360 ELSE d END AS d FROM b) SELECT station_id, round(d, 6) AS bearing, round(least(abs(d - 350), 360 - abs(d - 350)), 6) AS change FROM c"""))
def bearings(spark, sf_dir):
    s = A.stations(spark, sf_dir).withColumn("b", geo.bearing("lat", "lon", F.lit(10.0), F.lit(20.0)))
    return s.select("station_id", r6("b").alias("bearing"), r6(geo.bearing_change("b", F.lit(350.0))).alias("change"))


@query("centroids", with_("st", """+ v AS (SELECT country, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM st GROUP BY 1)
 SELECT country, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM v"""))
def centroids(spark, sf_dir):
    lat, lon = geo.centroid("lat", "lon")
    return A.stations(spark, sf_dir).groupBy("country").agg(r6(lat).alias("lat"), r6(lon).alias("lon"))


POINTS = "p AS (SELECT CASE WHEN user_id % 3 = 0 THEN '~' ELSE '' END || user_id AS hex, user_id % 4 AS type, t, event_id, t // 86400 AS file, t - t % 1800 AS slice, event_type NOT IN ('signup', 'error') AS airborne, value AS alt, value * 2 AS speed, CAST(user_id % 90 AS DOUBLE) AS lat, CAST(event_id % 180 AS DOUBLE) AS lon, CASE WHEN event_type = 'click' THEN 'C' || event_id END AS callsign FROM e)"


def point_rows(spark, sf_dir):
    """Events as points; addresses of a third of the users are no ICAO ones."""
    u, kind = F.col("user_id"), F.col("event_type")
    return A.events(spark, sf_dir).select(
        F.concat(F.when(u % 3 == 0, "~").otherwise(""), u.cast("string")).alias("hex"), (u % 4).alias("type"), "t", "event_id", F.floor(F.col("t") / 86400).alias("file"), timeutil.half_hour_floor("t").alias("slice"),
        (~kind.isin("signup", "error")).alias("airborne"), F.col("value").alias("alt"), (F.col("value") * 2).alias("speed"), (u % 90).cast("double").alias("lat"), (F.col("event_id") % 180).cast("double").alias("lon"),
        F.when(kind == "click", F.concat(F.lit("C"), F.col("event_id").cast("string"))).alias("callsign"),
    )


@query("point_summary", with_("e", f"""+ {POINTS} SELECT hex, type, count(*) AS n, list(t ORDER BY t, event_id)[1] AS first_t, list(lat ORDER BY t, event_id)[1] AS first_lat, list(lon ORDER BY t, event_id)[1] AS first_lon,
 list(t ORDER BY t, event_id)[-1] AS last_t, list(lat ORDER BY t, event_id)[-1] AS last_lat, list(lon ORDER BY t, event_id)[-1] AS last_lon, min(alt) AS alt_min, max(alt) AS alt_max, max(speed) AS speed_max,
 (list(callsign ORDER BY t, event_id) FILTER (callsign IS NOT NULL))[1] AS callsign FROM p WHERE hex LIKE '~%' GROUP BY 1, 2"""))
def point_summary(spark, sf_dir):
    return points.point_summary(point_rows(spark, sf_dir), ["t", "event_id"])


@query("peak_slices", with_("e", f"""+ {POINTS}, q AS (SELECT * FROM p WHERE hex LIKE '~%'), k AS (SELECT file, slice, count(DISTINCT hex) FILTER (airborne) AS k FROM q GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k DESC, slice) AS r FROM k)
 SELECT q.file, count(DISTINCT hex) AS objects, count(DISTINCT hex) FILTER (airborne) AS airborne, any_value(k) AS peak, any_value(b.slice) AS peak_slice FROM q JOIN b ON q.file = b.file AND r = 1 GROUP BY 1"""))
def peak_slices(spark, sf_dir):
    return points.peak_slices(point_rows(spark, sf_dir), "file", "slice")


@query("latest_points", with_("e", f"""+ {POINTS}, l AS (SELECT *, row_number() OVER (PARTITION BY file, hex ORDER BY airborne DESC, t DESC, event_id DESC) AS r FROM p WHERE hex LIKE '~%'), n AS (SELECT file, count(DISTINCT hex) AS total FROM p GROUP BY 1)
 SELECT file, hex, t, airborne, lat, lon, total FROM l JOIN n USING (file) WHERE r = 1"""))
def latest_points(spark, sf_dir):
    return points.latest_points(point_rows(spark, sf_dir), ["t", "event_id"], "file")
