"""Queries on alerts, evidence, lineage, calendars and classified records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import severity_rank
from ..functions.timeutil import FIXED, FLOATING, JUNETEENTH_FROM, nearest_holiday
from ..operators import graph, tables
from ..plans import alerts, baseline, problems
from . import query, r6, with_


def holiday_oracle(first: int, last: int) -> str:
    """CTEs y and hd (holiday, hday) for the years around."""
    parts = [f"SELECT '{k}' AS holiday, make_date(y, {m}, {d}) AS hday FROM y" + f" WHERE y >= {JUNETEENTH_FROM}" * (k == "juneteenth") for k, (m, d) in FIXED.items()]
    for k, (m, w, n) in FLOATING.items():
        start = f"make_date(y, {m}, 1)" if n else f"make_date(y, {m + 1}, 1)"
        parts.append(f"SELECT '{k}', CAST({start} + CAST((({w} - dayofweek({start})) % 7 + 7) % 7 + {7 * (n - 1)} AS INTEGER) AS DATE) FROM y")
    return f"y AS (SELECT CAST(unnest(generate_series({first - 1}, {last + 1})) AS INTEGER) AS y), hd AS ({' UNION ALL '.join(parts)})"


NEAR = holiday_oracle(1992, 2026) + """, dy AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
 nr AS (SELECT day, n, holiday, CAST(date_diff('day', hday, day) AS INTEGER) AS offset_, row_number() OVER (PARTITION BY day ORDER BY abs(date_diff('day', hday, day)), hday) AS k FROM dy LEFT JOIN hd ON date_diff('day', hday, day) BETWEEN -2 AND CASE WHEN holiday IN ('new_year', 'thanksgiving') THEN 3 ELSE 2 END)"""


def daily(spark, sf_dir):
    return baseline.daily_counts(A.table(spark, sf_dir, "orders"), "o_orderdate")


@query("holiday_calendar", f"WITH {NEAR} SELECT CAST(day AS VARCHAR) AS day, holiday, offset_ AS \"offset\" FROM nr WHERE k = 1 AND holiday IS NOT NULL")
def holiday_calendar(spark, sf_dir):
    return nearest_holiday(daily(spark, sf_dir).select("day"), "day", spark, 1992, 2026).filter("holiday is not null").withColumn("day", F.col("day").cast("string"))


@query("holiday_ratio", f"WITH {NEAR}, us AS (SELECT dayofweek(day) AS w, median(n) AS usual FROM dy GROUP BY 1) SELECT holiday, offset_ AS \"offset\", count(*) AS n_days, round(avg(least(2.25, greatest(0.25, n / greatest(usual, 1)))), 6) AS ratio FROM nr JOIN us ON dayofweek(day) = w WHERE k = 1 AND holiday IS NOT NULL GROUP BY 1, 2")
def holiday_ratio(spark, sf_dir):
    return baseline.holiday_ratios(daily(spark, sf_dir), spark, 1992, 2026).withColumn("ratio", r6("ratio"))


@query("holiday_adjustment", f"""WITH {NEAR}, us AS (SELECT dayofweek(day) AS w, median(n) AS usual FROM dy GROUP BY 1), en AS (SELECT holiday, year(day) AS occurrence, offset_ AS o, n / greatest(usual, 1) AS r FROM nr JOIN us ON dayofweek(day) = w WHERE k = 1 AND holiday IS NOT NULL),
 j AS (SELECT a.holiday, a.occurrence, a.o, b.r, exp(-0.5 * pow((a.o - b.o) / 0.35, 2)) * exp(-ln(2) / 3 * greatest(0, a.occurrence - b.occurrence - 1)) AS w FROM en a JOIN en b ON a.holiday = b.holiday AND b.occurrence < a.occurrence),
 t AS (SELECT holiday, occurrence, o, sum(w) AS w, sum(w * r) AS wr FROM j GROUP BY 1, 2, 3)
 SELECT holiday, occurrence, o AS "offset", round(least(2.25, greatest(0.25, 1 + (wr / w - 1) * w / (w + 1))), 6) AS ratio FROM t""")
def holiday_adjustment(spark, sf_dir):
    d = daily(spark, sf_dir)
    usual = d.groupBy(F.dayofweek("day").alias("dow")).agg(F.percentile(F.col("n").cast("double"), 0.5).alias("usual"))
    e = nearest_holiday(d, "day", spark, 1992, 2026).filter("holiday is not null").join(F.broadcast(usual), F.dayofweek("day") == F.col("dow"))
    e = e.select("holiday", F.year("day").alias("occurrence"), "offset", F.lit(0).alias("slot"), (F.col("n") / F.greatest("usual", F.lit(1.0))).alias("ratio"))
    return baseline.holiday_model(e).select("holiday", F.col("occurrence").cast("long").alias("occurrence"), "offset", r6("ratio").alias("ratio"))


@query("prior_year_ratio", """WITH dy AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), us AS (SELECT year(day) AS y, dayofweek(day) AS w, median(n) AS usual FROM dy GROUP BY 1, 2)
 SELECT CAST(a.day AS VARCHAR) AS day, round(least(2.25, greatest(0.25, p.n / greatest(usual, 1))), 6) AS ratio FROM dy a JOIN dy p ON p.day = CAST(a.day - INTERVAL 1 YEAR AS DATE) JOIN us ON year(p.day) = y AND dayofweek(p.day) = w""")
def prior_year_ratio(spark, sf_dir):
    return baseline.prior_year_ratios(daily(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), r6("ratio").alias("ratio"))


@query("corroboration_cap", with_("al", """+ lo AS (SELECT a.event_key FROM al a WHERE severity = 'critical' AND status <> 'sent' AND NOT EXISTS (SELECT 1 FROM al b WHERE b.severity IN ('high', 'critical') AND b.cohort <> a.cohort AND b.t BETWEEN a.t - 5400 AND a.t + 5400))
 SELECT al.event_key, CASE WHEN lo.event_key IS NOT NULL THEN 'high' ELSE severity END AS severity FROM al LEFT JOIN lo USING (event_key)"""))
def corroboration_cap(spark, sf_dir):
    return alerts.corroboration_cap(A.alerts(spark, sf_dir)).select("event_key", "severity")


def signals(spark, sf_dir):
    o, c = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    s = o.filter("o_orderpriority = '1-URGENT'").join(c, o.o_custkey == c.c_custkey)
    return s.select(
        F.col("o_orderkey").alias("key"), F.col("c_mktsegment").alias("kind"), (F.col("o_custkey") % 4).alias("family"), F.col("c_nationkey").alias("region"),
        ((F.col("c_nationkey") * 37) % 140 - 70).cast("double").alias("lat"), ((F.col("c_nationkey") * 73) % 340 - 170).cast("double").alias("lon"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"),
    )


@query("fusion_pairs", """WITH s AS (SELECT o_orderkey AS key, c_mktsegment AS kind, o_custkey % 4 AS family, c_nationkey AS region, CAST((c_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((c_nationkey * 73) % 340 - 170 AS DOUBLE) AS lon, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
 SELECT a.key AS a, b.key AS b FROM s a JOIN s b ON a.key < b.key AND a.kind <> b.kind AND a.family <> b.family AND b.t BETWEEN a.t - 5400 AND a.t + 5400
 WHERE a.region = b.region OR 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) <= 150""")
def fusion_pairs(spark, sf_dir):
    return alerts.fusion_pairs(signals(spark, sf_dir))


FUSION = """WITH RECURSIVE s AS (SELECT o_orderkey AS key, c_mktsegment AS kind, o_custkey % 4 AS family, c_nationkey AS region, CAST((c_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((c_nationkey * 73) % 340 - 170 AS DOUBLE) AS lon,
   CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'watch' END AS severity FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
 e AS (SELECT a.key AS a, b.key AS b, a.t AS ta, b.t AS tb, a.kind <> b.kind AND a.family <> b.family AS seed FROM s a JOIN s b ON a.key <> b.key AND abs(a.t - b.t) <= 5400
  WHERE a.region = b.region OR 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) <= 150),
 near AS (SELECT a, list(b) AS nb FROM e GROUP BY a),
 seeds AS (SELECT a, b, row_number() OVER (ORDER BY ta, a, tb, b) AS i FROM e WHERE seed AND (ta, a) < (tb, b)),
 fold AS (SELECT i, x.a, x.b, list_reduce([{'m': [x.a, x.b], 'nb': CAST([] AS BIGINT[])}] || coalesce(list({'m': [p.b], 'nb': n.nb} ORDER BY p.tb, p.b) FILTER (p.b IS NOT NULL), []),
   lambda g, c: CASE WHEN list_has_all(c.nb, g.m) THEN {'m': g.m || c.m, 'nb': CAST([] AS BIGINT[])} ELSE g END).m AS m
  FROM seeds x LEFT JOIN (e p JOIN e q ON p.b = q.b JOIN near n ON n.a = p.b) ON p.a = x.a AND q.a = x.b GROUP BY i, x.a, x.b),
 r(i, begun) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[][]) UNION ALL
  SELECT f.i, CASE WHEN len(list_filter(begun, lambda g: list_has_all(g, [f.a, f.b]))) > 0 THEN begun ELSE begun || [f.m] END FROM r JOIN fold f ON f.i = r.i + 1),
 g AS (SELECT DISTINCT list_sort(unnest(begun)) AS m FROM (SELECT begun FROM r ORDER BY i DESC LIMIT 1)),
 u AS (SELECT m, unnest(m) AS key FROM g)
 SELECT array_to_string(m, ',') AS members, CAST(len(m) AS BIGINT) AS size, CASE WHEN bool_or(kind = 'MACHINERY' AND severity IN ('high', 'critical')) THEN 5 ELSE 4 END AS level, max(t) AS t,
  CASE WHEN count(DISTINCT region) = 1 AND count(region) = count(*) THEN min(region) END AS region, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM u JOIN s USING (key) GROUP BY m"""


@query("fusion_groups", FUSION)
def fusion_groups(spark, sf_dir):
    """Groups of urgent orders with their level; segments are kinds, and one of them is official."""
    s = signals(spark, sf_dir).withColumn("severity", F.when(F.col("key") % 3 == 0, "high").otherwise("watch"))
    return alerts.fusion_events(alerts.fusion_groups(s), s, "MACHINERY").select(F.array_join("members", ",").alias("members"), "size", "level", "t", "region", r6("lat").alias("lat"), r6("lon").alias("lon"))


#: Orders up to the first day are in the old table, those from the second day on in the new one.
OLD_UNTIL, NEW_FROM = 851990400, 788918400


def batches(spark, sf_dir):
    a = A.alerts(spark, sf_dir)
    old = a.filter(F.col("t") <= OLD_UNTIL).select("event_key", "severity", "t", F.when(F.col("status") == "F", "sent").otherwise("pending").alias("status"))
    bump = F.when(F.col("event_key") % 5 == 0, "critical").when(F.col("event_key") % 7 == 0, "high").otherwise(F.col("severity"))
    return old, a.filter(F.col("t") >= NEW_FROM).select("event_key", bump.alias("severity"), (F.col("t") + 60).alias("t"))


UPSERT = with_("al", f"""+ ol AS (SELECT event_key, severity, t, CASE WHEN status = 'F' THEN 'sent' ELSE 'pending' END AS status FROM al WHERE t <= {OLD_UNTIL}),
 nw AS (SELECT event_key, CASE WHEN event_key % 5 = 0 THEN 'critical' WHEN event_key % 7 = 0 THEN 'high' ELSE severity END AS severity, t + 60 AS t FROM al WHERE t >= {NEW_FROM}),
 jn AS (SELECT coalesce(ol.event_key, nw.event_key) AS event_key, ol.severity AS os, nw.severity AS ns, ol.t AS ot, nw.t AS nt, ol.status, coalesce(list_position(['watch', 'elevated', 'high', 'critical'], ol.severity), 0) AS ro, coalesce(list_position(['watch', 'elevated', 'high', 'critical'], nw.severity), 0) AS rn FROM ol FULL JOIN nw ON ol.event_key = nw.event_key),
 up AS (SELECT event_key, CASE WHEN rn > ro THEN ns ELSE os END AS severity, greatest(coalesce(ot, nt), coalesce(nt, ot)) AS t, CASE WHEN status IS NULL OR (rn > ro AND ns IN ('high', 'critical')) THEN 'pending' ELSE status END AS status FROM jn)""")


@query("event_upsert", UPSERT + " SELECT event_key, severity, t, status FROM up")
def event_upsert(spark, sf_dir):
    return tables.severity_upsert(*batches(spark, sf_dir))


@query("latest_upsert", with_("al", f"SELECT event_key, CASE WHEN t >= {NEW_FROM} THEN 'b' ELSE 'a' END AS origin, CASE WHEN t >= {NEW_FROM} THEN t + 60 ELSE t END AS t FROM al"))
def latest_upsert(spark, sf_dir):
    old, new = batches(spark, sf_dir)
    return tables.upsert_latest(old.select("event_key", F.lit("a").alias("origin"), "t"), new.select("event_key", F.lit("b").alias("origin"), "t"), ["event_key"], "t")


@query("insert_ignore", with_("al", f"SELECT event_key, CASE WHEN t <= {OLD_UNTIL} THEN t ELSE t + 60 END AS t FROM al"))
def insert_ignore(spark, sf_dir):
    old, new = batches(spark, sf_dir)
    return tables.insert_ignore(old.select("event_key", "t"), new.select("event_key", "t"), ["event_key"])


@query("unpublished_events", UPSERT + " SELECT event_key, severity FROM up WHERE severity IN ('high', 'critical') AND NOT EXISTS (SELECT 1 FROM al p WHERE p.event_key = up.event_key AND p.severity = up.severity AND p.status = 'F')")
def unpublished_events(spark, sf_dir):
    published = A.alerts(spark, sf_dir).filter("status = 'F'")
    return tables.unpublished(tables.severity_upsert(*batches(spark, sf_dir)), published).select("event_key", "severity")


@query("severity_page", with_("al", "+ r AS (SELECT *, CAST(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'elevated' THEN 3 ELSE 1 END AS INTEGER) AS rank FROM al) SELECT event_key, t, rank FROM r WHERE rank < 4 OR (rank = 4 AND (t < 820454400 OR (t = 820454400 AND event_key > 100))) ORDER BY rank DESC, t DESC, event_key LIMIT 25"))
def severity_page(spark, sf_dir):
    return tables.keyset_page(A.alerts(spark, sf_dir), severity_rank("severity"), "t", "event_key", (4, 820454400, 100), 25).select("event_key", "t", "rank")


@query("round_robin_evidence", """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS turn_no, max(conv_id) OVER (PARTITION BY role) AS newest FROM conversations)
 SELECT conv_id, turn, role, turn_no FROM r ORDER BY turn_no, newest DESC, role LIMIT 30""")
def round_robin_evidence(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    return tables.round_robin(c, "role", [F.desc("conv_id"), F.desc("turn")], "conv_id", 30).select("conv_id", "turn", "role", "turn_no")


@query("evidence_heads", "SELECT role AS source_id, conv_id AS external_id, max(turn) AS turn, arg_max(sha256(text), turn) AS digest, count(DISTINCT sha256(text)) AS revisions FROM conversations GROUP BY 1, 2")
def evidence_heads(spark, sf_dir):
    return alerts.head_revisions(A.evidence(spark, sf_dir)).select("source_id", "external_id", "turn", "digest", "revisions")


def lineage(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    return c.join(first, "conv_id").select(node(F.col("turn")).alias("successor"), F.when(F.col("turn") > F.col("first"), node(F.col("turn") - 1)).alias("predecessor"))


@query("lineage_closure", "WITH f AS (SELECT conv_id, min(turn) AS m FROM conversations GROUP BY 1), c AS (SELECT DISTINCT conv_id, turn, m FROM conversations JOIN f USING (conv_id)) SELECT conv_id || ':' || turn AS node, conv_id || ':' || a AS ancestor, CAST(turn - a AS BIGINT) AS depth FROM (SELECT conv_id, turn, unnest(generate_series(m, turn - 1)) AS a FROM c WHERE turn > m)")
def lineage_closure(spark, sf_dir):
    return graph.ancestors(lineage(spark, sf_dir), "successor", "predecessor")


@query("lineage_heads", "SELECT conv_id || ':' || turn AS successor FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def lineage_heads(spark, sf_dir):
    e = lineage(spark, sf_dir)
    return graph.heads(e.select("successor"), e, "successor", "predecessor")


@query("incident_threads", with_("al", "+ x AS (SELECT cohort, t, event_key FROM al WHERE severity = 'critical'), d AS (SELECT cohort, t, coalesce(t - lag(t) OVER (PARTITION BY cohort ORDER BY t) > 3 * 86400, true) AS new FROM x), g AS (SELECT cohort, t, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY cohort ORDER BY t ROWS UNBOUNDED PRECEDING) AS thread FROM d) SELECT cohort, CAST(thread AS BIGINT) AS thread, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY 1, 2"))
def incident_threads(spark, sf_dir):
    return alerts.incident_threads(A.alerts(spark, sf_dir).filter("severity = 'critical'"), "cohort", "t")


@query("asof_notice_status", """WITH n AS (SELECT o_orderkey AS message_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS onset FROM orders), c AS (SELECT l_orderkey AS message_id, bool_or(l_returnflag = 'R') AS can, bool_or(l_returnflag = 'A') AS sup FROM lineitem WHERE l_returnflag <> 'N' AND epoch(l_shipdate) <= 820454400 GROUP BY 1)
 SELECT message_id, CASE WHEN can THEN 'cancelled' WHEN sup THEN 'superseded' WHEN onset + 2592000 <= 820454400 THEN 'expired' WHEN onset > 820454400 THEN 'upcoming' ELSE 'active' END AS status FROM n LEFT JOIN c USING (message_id)""")
def asof_notice_status(spark, sf_dir):
    o, li = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "lineitem")
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    notices = o.select(F.col("o_orderkey").alias("message_id"), t("o_orderdate").alias("onset"), (t("o_orderdate") + 2592000).alias("expires"))
    controls = li.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("ref_id"), F.when(F.col("l_returnflag") == "R", "cancel").otherwise("update").alias("action"), t("l_shipdate").alias("t"))
    return alerts.asof_status(notices, controls, 820454400).select("message_id", "status")


@query("problem_pages")
def problem_pages(spark, sf_dir):
    """Events as checks a minute apart, one box a type of event: a problem is a user with a high value."""
    e = A.events(spark, sf_dir)
    problem = F.when(F.col("value") > 60, F.concat(F.lit("feed "), (F.col("user_id") % 2).cast("string"), F.lit(" is late ("), F.col("value").cast("int").cast("string"), F.lit(" s)")))
    return problems.problem_pages(e.select(F.col("event_type").alias("box"), (F.col("event_id") * 60).alias("t"), problem.alias("problem"))).withColumn("problems", F.array_join("problems", ","))


#: Ordered rules, the first that matches names the category.
CATEGORY_RULES = ((r"^PROMO", "promotional"), (r"(BRASS|COPPER)$", "warm metal"), (r"STEEL|NICKEL", "cold metal"), (r"^(SMALL|MEDIUM)", "compact"))


@query("category_rules", "SELECT CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{c}'" for p, c in CATEGORY_RULES) + " ELSE 'other' END AS category, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1")
def category_rules(spark, sf_dir):
    rule = F.lit("other")
    for pattern, name in reversed(CATEGORY_RULES):
        rule = F.when(F.col("p_type").rlike(pattern), name).otherwise(rule)
    return A.table(spark, sf_dir, "part").groupBy(rule.alias("category")).agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("price"))


@query("severity_counts", with_("al", "SELECT cohort, count(*) FILTER (severity IN ('high', 'critical')) AS public, count(*) FILTER (status = 'F') AS closed, count(*) AS n, max(t) AS last FROM al GROUP BY 1"))
def severity_counts(spark, sf_dir):
    a = A.alerts(spark, sf_dir)
    return a.groupBy("cohort").agg(F.count_if(F.col("severity").isin("high", "critical")).alias("public"), F.count_if(F.col("status") == "F").alias("closed"), F.count("*").alias("n"), F.max("t").alias("last"))
