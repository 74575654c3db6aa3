"""Queries on members, references, schedules, notices and their predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import term_pattern
from ..functions.timeutil import unix
from ..operators import joins, records, sequences
from ..plans import notices
from . import query, r6, with_

#: Days that part old from new rows of the events, and moments of the events and the orders.
EARLY, LATE, NOW, ORDERS_NOW = 1704931200, 1705795200, 1705276800, 820454400
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"


@query("provenance_upsert", with_("e s", f"""+ a AS (SELECT slot, CASE WHEN n % 2 = 0 THEN 'live' ELSE 'back' END AS source, n AS total, n % 2 = 0 AS live FROM s WHERE slot < {LATE}),
 b AS (SELECT slot, CASE WHEN n % 3 = 0 THEN 'live' ELSE 'back' END AS source, n + n % 5 - 2 AS total, n % 3 = 0 AS live FROM s WHERE slot >= {EARLY})
 SELECT coalesce(a.slot, b.slot) AS slot, CASE WHEN b.slot IS NULL OR (a.live AND NOT b.live) THEN a.source ELSE b.source END AS source, greatest(coalesce(a.total, b.total), coalesce(b.total, a.total)) AS total, coalesce(a.live, false) OR coalesce(b.live, false) AS live FROM a FULL JOIN b ON a.slot = b.slot"""))
def provenance_upsert(spark, sf_dir):
    s = A.slot_counts(spark, sf_dir)
    one = lambda total, live: ["slot", F.when(live, "live").otherwise("back").alias("source"), total.alias("total"), live.alias("live")]
    n = F.col("n")
    return records.provenance_upsert(s.filter(F.col("slot") < LATE).select(*one(n, n % 2 == 0)), s.filter(F.col("slot") >= EARLY).select(*one(n + n % 5 - 2, n % 3 == 0)))


@query("evidence_prune", with_("al", f"SELECT event_key, t FROM al WHERE t >= {ORDERS_NOW} OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_key AND l_returnflag = 'R')"))
def evidence_prune(spark, sf_dir):
    refs = A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_key")).distinct()
    return records.pruned(A.alerts(spark, sf_dir).select("event_key", "t"), "event_key", "t", ORDERS_NOW, refs)


@query("membership_flags", with_("e", f"""+ a AS (SELECT DISTINCT user_id FROM e WHERE t < {NOW} AND t >= {NOW} - 86400), b AS (SELECT DISTINCT user_id FROM e WHERE t >= {NOW} AND t < {NOW} + 86400)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, b.user_id IS NOT NULL AS active, CASE WHEN a.user_id IS NULL THEN 'entered' WHEN b.user_id IS NULL THEN 'left' ELSE 'stayed' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id"""))
def membership_flags(spark, sf_dir):
    """Users of one day as the active list, those of the next as the snapshot that replaces it."""
    e = A.events(spark, sf_dir)
    day = lambda first: e.filter(F.col("t").between(first, first + 86399)).select("user_id").distinct()
    return records.membership(day(NOW - 86400), day(NOW), "user_id")


@query("first_with_conflicts", "WITH f AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)[1] AS first FROM lineitem GROUP BY 1) SELECT l_orderkey, first, count(*) AS n, count(*) FILTER (l_returnflag <> first) AS conflicts FROM lineitem JOIN f USING (l_orderkey) GROUP BY 1, 2")
def first_with_conflicts(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    return records.first_with_conflicts(A.table(spark, sf_dir, "lineitem"), "l_orderkey", order, "l_returnflag")


@query("budget_split", "SELECT " + ", ".join(f"CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = '{x}'), 0) AS BIGINT) AS \"{x}\"" for x in "ANR") + ", CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS total FROM lineitem")
def budget_split(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("charge"), "l_returnflag")
    return records.budget_split(rows, "charge", "l_returnflag", list("ANR"))


@query("delta_summary", """WITH d AS (SELECT n_name AS cell, CAST(count(*) FILTER (year(o_orderdate) = 1997) - count(*) FILTER (year(o_orderdate) = 1996) AS BIGINT) AS delta FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
 SELECT count(*) AS cells, CAST(coalesce(sum(delta) FILTER (delta > 0), 0) AS BIGINT) AS positive, CAST(coalesce(sum(delta) FILTER (delta < 0), 0) AS BIGINT) AS negative, CAST(sum(delta) AS BIGINT) AS net, list(cell ORDER BY delta DESC, cell)[1] AS top_cell FROM d""")
def delta_summary(spark, sf_dir):
    o, c, n = (A.table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    year = lambda y: F.count_if(F.year("o_orderdate") == y)
    d = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg((year(1997) - year(1996)).alias("delta"))
    return records.delta_summary(d.join(n, d.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("cell"), "delta"), "cell")


@query("cluster_diameters", with_("st", f"SELECT a.country, round(coalesce(max({HAVERSINE.format(a='a.', b='b.')}) FILTER (a.station_id < b.station_id), 0), 6) AS km FROM st a JOIN st b ON a.country = b.country GROUP BY 1"))
def cluster_diameters(spark, sf_dir):
    return records.cluster_diameters(A.stations(spark, sf_dir), "country", "station_id").select("country", r6("km").alias("km"))


@query("shared_member_matches", with_("e", "+ m AS (SELECT DISTINCT event_type, t // 3600 AS hour, user_id FROM e WHERE event_type IN ('click', 'signup')) SELECT DISTINCT a.hour AS a, b.hour AS b FROM m a JOIN m b ON a.hour = b.hour AND a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'signup'"))
def shared_member_matches(spark, sf_dir):
    """Hours whose clicking users and new users overlap; a member is a user in an hour."""
    e = A.events(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600))
    member = F.concat_ws(":", F.col("hour").cast("string"), F.col("user_id").cast("string"))
    of = lambda kind, key: e.filter(F.col("event_type") == kind).groupBy(F.col("hour").alias(key)).agg(F.collect_set(member).alias("m"))
    return records.shared_member_matches(of("click", "a"), of("signup", "b"), "a", "b", "m")


@query("resolved_references", """WITH ev AS (SELECT o_orderpriority AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, 'c' || o_custkey AS message_id FROM orders),
 rf AS (SELECT DISTINCT o_orderpriority AS source_id, CASE WHEN l_returnflag = 'R' THEN 'c' || o_custkey ELSE CAST(l_orderkey - 1 AS VARCHAR) END AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT DISTINCT source_id, ref, external_id FROM rf JOIN ev USING (source_id) WHERE ref = external_id OR ref = message_id""")
def resolved_references(spark, sf_dir):
    o, li = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "lineitem")
    message = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    ev = o.select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"), message.alias("message_id"))
    ref = F.when(F.col("l_returnflag") == "R", message).otherwise((F.col("l_orderkey") - 1).cast("string"))
    rows = li.count() + o.count()
    both = joins.dealt(li, o, "l_orderkey", "o_orderkey", rows)
    refs = both.select(F.col("o_orderpriority").alias("source_id"), ref.alias("ref")).distinct()
    return records.resolved_references(refs.repartition(joins.parts(spark, rows), "source_id", "ref"), ev)


@query("context_candidates", with_("e", """+ x AS (SELECT event_id, event_type, user_id, t, unnest([concat('v', CAST(floor(value / 20) AS BIGINT)), concat('t', CAST(floor(value) AS BIGINT) % 3)]) AS topic FROM e),
 j AS (SELECT DISTINCT a.event_id AS focus_id, b.event_id AS id, b.t FROM x a JOIN x b ON a.user_id = b.user_id AND a.topic = b.topic AND a.event_type <> b.event_type AND b.t BETWEEN a.t - 259200 AND a.t WHERE a.event_type = 'error'),
 k AS (SELECT focus_id, id, row_number() OVER (PARTITION BY focus_id ORDER BY t DESC, id) AS place FROM j) SELECT * FROM k WHERE place <= 12"""))
def context_candidates(spark, sf_dir):
    topics = F.array(F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")), F.concat(F.lit("t"), (F.floor("value") % 3).cast("string")))
    rows = A.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("user_id").alias("region"), topics.alias("topics"), "t")
    focus = rows.filter("source = 'error'").withColumnRenamed("id", "focus_id")
    return records.context_candidates(focus, rows).select("focus_id", "id", F.col("place").cast("long").alias("place"))


@query("due_sources", """WITH s AS (SELECT s_suppkey AS id, 60 * (1 + s_nationkey % 5) AS period, CASE WHEN s_acctbal >= 0 THEN 1000000 - s_suppkey * 7 % 500 END AS checked, CASE WHEN s_nationkey > 12 THEN 1000000 + 10 * (s_nationkey - 18) END AS retry_after FROM supplier)
 SELECT id FROM s WHERE (checked IS NULL OR 1000000 // period > checked // period) AND (retry_after IS NULL OR retry_after <= 1000000)""")
def due_sources(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (60 * (1 + F.col("s_nationkey") % 5)).alias("period"), F.when(F.col("s_acctbal") >= 0, 1000000 - F.col("s_suppkey") * 7 % 500).alias("checked"),
        F.when(F.col("s_nationkey") > 12, 1000000 + 10 * (F.col("s_nationkey") - 18)).alias("retry_after"),
    )
    return records.due_sources(s, 1000000).select("id")


@query("live_days", with_("e s", "+ d AS (SELECT t // 86400 AS day, count(*) AS n FROM e GROUP BY 1) SELECT slot, n >= (SELECT avg(n) FROM d) AS live FROM (SELECT slot FROM s) JOIN d ON day = slot // 86400"))
def live_days(spark, sf_dir):
    """Half hours of days with at least the mean number of events."""
    e = A.events(spark, sf_dir)
    mean = e.agg((F.count("*") / F.countDistinct(F.floor(F.col("t") / 86400))).alias("m")).first()["m"]
    return records.live_days(A.slot_counts(spark, sf_dir), e, mean)


@query("hole_ranges", with_("e s", """+ m AS (SELECT slot FROM s WHERE slot NOT IN (SELECT t - t % 1800 FROM e WHERE event_type = 'error')), g AS (SELECT slot, slot - 1800 * row_number() OVER (ORDER BY slot) AS run FROM m)
 SELECT min(slot) AS start, max(slot) AS "end", count(*) AS n FROM g GROUP BY run"""))
def hole_ranges(spark, sf_dir):
    """Runs of half hours with events but no errors."""
    errors = A.slot_counts_by(spark, sf_dir).filter("series = 'error'").select("slot")
    return records.hole_ranges(A.slot_counts(spark, sf_dir).select("slot").join(errors, "slot", "left_anti"), 1800)


@query("neighbourhoods", with_("st", """+ c AS (SELECT CAST(floor(lat / 20) AS BIGINT) AS r, CAST(floor(lon / 20) AS BIGINT) AS c, count(*) AS v FROM st GROUP BY 1, 2)
 SELECT DISTINCT string_agg(b.r || ':' || b.c, ',' ORDER BY b.r || ':' || b.c) AS cells, CAST(sum(b.v) AS BIGINT) AS total, count(*) AS n FROM c a JOIN c b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c"""))
def neighbourhoods(spark, sf_dir):
    cells = A.stations(spark, sf_dir).groupBy(F.floor(F.col("lat") / 20).alias("r"), F.floor(F.col("lon") / 20).alias("c")).agg(F.count("*").alias("v"))
    return records.neighbourhoods(cells, "r", "c", "v").withColumn("cells", F.array_join("cells", ","))


@query("rate_limited", """WITH RECURSIVE x AS (SELECT user_id, event_id * 60 AS t, CASE WHEN value > 60 THEN 'critical' WHEN value > 30 THEN 'high' ELSE 'elevated' END AS severity FROM events), p AS (SELECT user_id, t FROM x WHERE severity <> 'elevated'),
 r AS (SELECT user_id, min(t) AS t FROM p GROUP BY 1 UNION ALL SELECT r.user_id, min(p.t) FROM r JOIN p ON p.user_id = r.user_id AND p.t >= r.t + 21600 GROUP BY 1)
 SELECT x.user_id, x.t, CASE WHEN severity <> 'elevated' AND r.t IS NULL THEN 'watch' ELSE severity END AS severity FROM x LEFT JOIN r ON r.user_id = x.user_id AND r.t = x.t""")
def rate_limited(spark, sf_dir):
    """Events a minute apart: a public one lowers those of its user within six hours."""
    severity = F.when(F.col("value") > 60, "critical").when(F.col("value") > 30, "high").otherwise("elevated")
    return sequences.rate_limited(A.events(spark, sf_dir).select("user_id", (F.col("event_id") * 60).alias("t"), severity.alias("severity")), "user_id", "t", "severity", 21600)


@query("byte_budget", """WITH RECURSIVE x AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS turn, CAST(600 AS BIGINT) AS room, false AS keep FROM x UNION ALL SELECT x.conv_id, x.k, x.turn, CASE WHEN x.n <= r.room THEN r.room - x.n ELSE r.room END, x.n <= r.room FROM r JOIN x ON x.conv_id = r.conv_id AND x.k = r.k + 1) SELECT conv_id, turn FROM r WHERE keep""")
def byte_budget(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return sequences.byte_budget(c, "conv_id", "turn", "n", 600).select("conv_id", "turn")


@query("adjacent_distinct", with_("e", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e) WHERE before IS DISTINCT FROM event_type"))
def adjacent_distinct(spark, sf_dir):
    return sequences.adjacent_distinct(A.events(spark, sf_dir), "user_id", ["t", "event_id"], [F.col("event_type")]).select("event_id", "user_id", "event_type")


@query("archive_expand", with_("e", "SELECT DISTINCT event_type AS series, t - t % 1800 AS slot FROM e"))
def archive_expand(spark, sf_dir):
    """Slots of each series written as runs of equal steps, and read back."""
    s = A.slot_counts_by(spark, sf_dir)
    step = F.coalesce(F.col("slot") - F.lag("slot").over(sequences.by("series", "slot")), F.lit(0))
    runs = sequences.run_lengths(s.withColumn("step", step), "series", "slot", "step")
    runs = runs.withColumn("start", F.min("first").over(Window.partitionBy("series")))
    return sequences.expand_runs(runs, "series", "run", "step", "n", F.col("start")).select("series", F.col("value").alias("slot"))


@query("valid_points", "SELECT c_custkey, abs(c_acctbal / 50) <= 90 AND abs(c_acctbal / 25) <= 180 AS valid FROM customer")
def valid_points(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("lat"), (F.col("c_acctbal") / 25).alias("lon"))
    return c.select("c_custkey", notices.valid_point().alias("valid"))


@query("usable_readings", "SELECT l_suppkey AS station_id, count(*) AS n, count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'R' AND l_discount < 0.08) AS usable FROM lineitem GROUP BY 1")
def usable_readings(spark, sf_dir):
    unit, status = F.when(F.col("l_linestatus") == "F", "uSv").otherwise("cpm"), F.when(F.col("l_returnflag") == "R", "Test").otherwise("ok")
    r = A.table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_json(F.struct(unit.alias("unit"), status.alias("status"), (F.col("l_discount") < 0.08).alias("approved"))).alias("payload"))
    return r.groupBy(F.col("l_suppkey").alias("station_id")).agg(F.count("*").alias("n"), F.count_if(notices.usable_reading("payload", ["uSv"], ["test"])).alias("usable"))


@query("valid_slot_metadata", "SELECT p_partkey, p_size * 2 BETWEEN 1 AND 60 AND p_size >= 5 AS valid FROM part")
def valid_slot_metadata(spark, sf_dir):
    payload = F.to_json(F.struct((F.col("p_size") * 2).alias("sample_minutes"), F.create_map("p_brand", F.col("p_size") - 5).alias("counts")))
    return A.table(spark, sf_dir, "part").withColumn("payload", payload).select("p_partkey", notices.valid_slot_counts("payload").alias("valid"))


@query("eligible_incidents", with_("e", f"SELECT event_id FROM e WHERE event_type IN ('click', 'signup', 'error') AND value <= 80 AND t BETWEEN {NOW} - 172800 AND {NOW} + 300 AND CAST(floor(value / 10) AS BIGINT) % 4 = 1"))
def eligible_incidents(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "notice").when(F.col("event_type") == "signup", "report").when(F.col("event_type") == "error", "official_alert").otherwise("post")
    topic = F.concat(F.lit("topic "), (F.floor(F.col("value") / 10) % 4).cast("string"))
    e = A.events(spark, sf_dir).select("event_id", "t", kind.alias("kind"), F.when(F.col("value") > 80, "cancelled").otherwise("active").alias("status"), F.array(topic).alias("topics"))
    return e.filter(notices.eligible_incident(NOW, ["topic 1", "topic 9"])).select("event_id")


@query("deliverable", with_("al", f"SELECT event_key FROM al WHERE (status = 'O' OR (status = 'F' AND t < {ORDERS_NOW} - 600)) AND (event_key * 3) % 7 < 5"))
def deliverable(spark, sf_dir):
    status = F.when(F.col("status") == "O", "pending").when(F.col("status") == "F", "processing").otherwise("sent")
    a = A.alerts(spark, sf_dir).select("event_key", status.alias("status"), F.col("t").alias("leased_at"), ((F.col("event_key") * 3) % 7).alias("attempts"))
    return a.filter(notices.deliverable(ORDERS_NOW)).select("event_key")


@query("active_subscribers", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND (c_nationkey < 10 OR c_mktsegment = 'MACHINERY' OR c_nationkey > 20)")
def active_subscribers(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, 1).alias("unsubscribed_at"), (F.col("c_nationkey") < 10).alias("email_confirmed"), (F.col("c_mktsegment") == "MACHINERY").alias("phone_confirmed"),
        F.when(F.col("c_nationkey") > 20, "p").alias("push_endpoint"),
    )
    return c.filter(notices.active_subscriber()).select("c_custkey")


#: Names of attributions and what a text must have.
ATTRIBUTIONS = {"english": "(^|[ \n])[Tt]he[ \n]", "french": "(^|[ \n])[Ll]es?[ \n]", "numbers": "[0-9]{4}"}


@query("attributed", "SELECT doc_id, concat_ws(','" + "".join(f", CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in ATTRIBUTIONS.items()) + ") AS names FROM documents")
def attributed(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.array_join(notices.attributed("text", ATTRIBUTIONS), ",").alias("names"))


#: States of area codes, by letters or digits.
STATES = {"11": "District", "06": "California", "48": "Texas", "EC": "Ohio", "ST": "Texas", "PR": "Iowa"}


@query("code_states", f"""WITH t(code, state) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in STATES.items())}), c AS (SELECT p_partkey, lpad(CAST(p_size * 1000 + p_partkey % 7 AS VARCHAR), 6, '0') AS a, substring(p_type, 1, 2) || 'Z001' AS b FROM part)
 SELECT p_partkey, array_to_string(list_sort(list_distinct([t.state, u.state])), ',') AS states FROM c LEFT JOIN t ON t.code = substring(a, 2, 2) LEFT JOIN t u ON u.code = substring(b, 1, 2)""")
def code_states(spark, sf_dir):
    codes = F.array(F.lpad((F.col("p_size") * 1000 + F.col("p_partkey") % 7).cast("string"), 6, "0"), F.concat(F.substring("p_type", 1, 2), F.lit("Z001")))
    return A.table(spark, sf_dir, "part").withColumn("codes", codes).select("p_partkey", F.array_join(notices.code_states("codes", STATES), ",").alias("states"))


@query("normalized_registrations", "SELECT c_custkey, upper(replace(replace(trim('  n-' || c_mktsegment || ' ' || c_nationkey || ' '), ' ', ''), '-', '')) AS registration FROM customer")
def normalized_registrations(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").withColumn("x", F.concat(F.lit("  n-"), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" ")))
    return c.select("c_custkey", notices.normalized_registration("x").alias("registration"))


@query("odds_text", """WITH n AS (SELECT p_partkey, 1 / (1 / (p_retailprice * p_size + 0.37)) AS n FROM part), s AS (SELECT *, pow(10.0, greatest(floor(log10(n)) - 1, 0)) AS scale FROM n)
 SELECT p_partkey, '1 in ' || format('{:,}', CAST(floor(n / scale + 0.5) * scale AS BIGINT)) AS odds FROM s""")
def odds_text(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", (1 / (F.col("p_retailprice") * F.col("p_size") + 0.37)).alias("tail"))
    return p.select("p_partkey", notices.odds_text("tail").alias("odds"))


@query("aircraft_summary", with_("e", """+ o AS (SELECT event_type, user_id, bool_or(value > 90 OR event_id % 101 = 0) AS urgent, bool_or(user_id % 5 = 1) AS military, user_id % 6 AS type FROM e GROUP BY ALL)
 SELECT event_type, count(*) AS n, count(*) FILTER (urgent) AS emergencies, count(*) FILTER (military) AS military, concat_ws(',', CASE WHEN bool_or(type = 1) THEN 'T1:' || count(*) FILTER (type = 1) END, CASE WHEN bool_or(type = 3) THEN 'T3:' || count(*) FILTER (type = 3) END) AS special FROM o GROUP BY 1"""))
def aircraft_summary(spark, sf_dir):
    e = A.events(spark, sf_dir).select(
        "event_type", F.col("user_id").alias("hex"), F.when(F.col("value") > 90, "7700").otherwise("1200").alias("squawk"), F.when(F.col("event_id") % 101 == 0, "general").otherwise("none").alias("emergency"),
        F.when(F.col("user_id") % 5 == 1, 3).otherwise(2).alias("flags"), F.concat(F.lit("T"), (F.col("user_id") % 6).cast("string")).alias("type"),
    )
    s = notices.aircraft_summary(e, ["event_type"], ["T1", "T3"])
    return s.withColumn("special", F.array_join(F.transform(F.map_entries("special"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ","))


@query("report_blocks", "SELECT CAST(l_linenumber AS BIGINT) AS number, 'P' || l_partkey AS facility, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS cause_text FROM lineitem")
def report_blocks(spark, sf_dir):
    """Reports of one order each, with a block for each line, taken apart again."""
    cause = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    block = F.concat(F.lit("Event Number: "), F.col("l_linenumber").cast("string"), F.lit("\nCause Text: "), cause, F.lit("\nFacility: P"), F.col("l_partkey").cast("string"), F.lit("\n"))
    pages = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Report\n"), F.array_join(F.collect_list(block), "")).alias("body"))
    return notices.report_blocks(pages, "body", "Event Number:", ["Facility", "Cause Text"])


POWER = "p AS (SELECT l_suppkey AS unit, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t, CAST(l_quantity * 2 AS BIGINT) AS power FROM lineitem), b AS (SELECT *, max(t * 1000 + power) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1800 PRECEDING) % 1000 AS before FROM p), dr AS (SELECT * FROM b WHERE before >= 50 AND power <= 5)"


def power(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), unix("l_shipdate").alias("t"), (F.col("l_quantity") * 2).cast("long").alias("power"))


@query("reactor_drops", f"WITH {POWER} SELECT unit, t, before, power FROM dr")
def reactor_drops(spark, sf_dir):
    return notices.reactor_drops(power(spark, sf_dir))


@query("many_trips", f"WITH {POWER} SELECT unit // 40 AS site, t, units FROM (SELECT *, count(DISTINCT unit) OVER (PARTITION BY unit // 40 ORDER BY t RANGE BETWEEN CURRENT ROW AND 864000 FOLLOWING) AS units FROM dr) WHERE units >= 3")
def many_trips(spark, sf_dir):
    """Sites of forty units each, with drops within ten days."""
    drops = notices.reactor_drops(power(spark, sf_dir)).withColumn("site", F.floor(F.col("unit") / 40))
    return notices.many_trips(drops, "site", 3, 864000).select("site", "t", F.col("units").cast("long").alias("units"))


@query("first_restrictions", with_("st", f"""+ f AS (SELECT o_custkey AS key, min(CAST(floor(epoch(o_orderdate)) AS BIGINT)) AS t, any_value((c_nationkey * 37) % 140 - 70.25) AS lat, any_value((c_nationkey * 73) % 340 - 170.25) AS lon FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
 j AS (SELECT key, t, station_id AS site_id, {HAVERSINE.format(a="f.", b="st.")} AS km FROM f JOIN st ON abs(f.lat - st.lat) <= 2 WHERE {HAVERSINE.format(a="f.", b="st.")} <= 80)
 SELECT key, t, arg_min(site_id, km) AS site_id, round(min(km), 6) AS km FROM j GROUP BY 1, 2"""))
def first_restrictions(spark, sf_dir):
    o, c = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    r = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("key"), ((F.col("c_nationkey") * 37) % 140 - 70.25).alias("lat"), ((F.col("c_nationkey") * 73) % 340 - 170.25).alias("lon"), unix("o_orderdate").alias("t"))
    sites = A.stations(spark, sf_dir).select(F.col("station_id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    return notices.first_restrictions(r, sites).select("key", "t", "site_id", r6("km").alias("km"))


#: Terms looked up as whole words.
TERMS = ("that", "dans", "the")


@query("outbreak_notices", "SELECT * FROM (SELECT doc_id, concat_ws(','" + "".join(f", CASE WHEN regexp_matches(lower(text), '{term_pattern(t)}') THEN '{t}' END" for t in TERMS) + ") AS agents FROM documents) WHERE agents <> ''")
def outbreak_notices(spark, sf_dir):
    return notices.outbreak_notices(A.table(spark, sf_dir, "documents"), "text", list(TERMS)).select("doc_id", F.array_join("agents", ",").alias("agents"))
