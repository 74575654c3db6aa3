"""Queries on official notices: orders as messages of the Common Alerting Protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.timeutil import DAY, unix
from ..plans import official
from ..sources import cap
from . import query

#: Instants: the first days of half years.
START, END, STEP = 788918400, 1009843200, 182 * DAY


def features(spark, sf_dir):
    """Orders as features: every fifth amends the order seven before it, every ninth cancels it, and some name the wrong sender."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), unix("o_orderdate").alias("t"), F.col("o_custkey").alias("c"))
    past = o.select((F.col("k") + 7).alias("k"), F.col("t").alias("rt"))
    stamp = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("k") % 9 == 0, "Cancel").when(F.col("k") % 5 == 0, "Update").otherwise("Alert")
    who = lambda k: F.concat(F.lit("office "), (k % 3).cast("string"))
    ref = F.struct(who(F.when(F.col("k") % 4 == 0, F.col("k") - 8).otherwise(F.col("k") - 7)).alias("sender"), (F.col("k") - 7).cast("string").alias("identifier"), stamp(F.col("rt")).alias("sent"))
    states = F.array(*map(F.lit, cap.STATES))
    ugc = F.when(F.col("k") % 13 == 0, F.array(F.lit("Texas"))).when(F.col("k") % 17 == 0, F.array(F.lit("XXC001"))).otherwise(F.array(F.concat(states[(F.col("c") % 57).cast("int")], F.lit("C"), F.lpad((F.col("k") % 1000).cast("string"), 3, "0"))))
    same = F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("0"), F.lpad((F.col("c") % 57).cast("string"), 2, "0"), F.lit("001"))))
    p = F.struct(
        F.col("k").cast("string").alias("id"), who(F.col("k")).alias("sender"), F.lit("Civil Danger Warning").alias("event"), F.when(F.col("k") % 19 == 0, "Test").otherwise("Actual").alias("status"), kind.alias("messageType"),
        F.lit("Public").alias("scope"), stamp(F.col("t")).alias("sent"), F.when(F.col("k") % 3 == 0, stamp(F.col("t") + DAY * (F.col("k") % 400))).alias("effective"),
        F.when(F.col("k") % 23 == 0, F.lit("2001-02-30T00:00:00Z")).otherwise(stamp(F.col("t") + DAY * 350)).alias("expires"), F.when(F.col("k") % 8 == 0, stamp(F.col("t") + DAY * 200)).alias("ends"),
        F.when((kind != "Alert") & F.col("rt").isNotNull(), F.array(ref)).alias("references"), F.struct(ugc.alias("UGC"), same.alias("SAME")).alias("geocode"),
    )
    return o.join(past, "k", "left").select(F.when(F.col("t") > 946684800, "active").otherwise("history").alias("lane"), F.to_json(F.struct(p.alias("properties"))).alias("feature"))


CAP = f"""WITH o AS (SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_custkey AS c FROM orders),
 st AS (SELECT string_split('{" ".join(cap.STATES)}', ' ') AS s, MAP {{{", ".join(f"'{k}': '{v}'" for k, v in cap.SAME.items())}}} AS f),
 m AS (SELECT o.k, o.t, CASE WHEN o.k % 9 = 0 THEN 'Cancel' WHEN o.k % 5 = 0 THEN 'Update' ELSE 'Alert' END AS kind, o.k % 19 <> 0 AS actual, CASE WHEN o.k % 3 = 0 THEN o.t + 86400 * (o.k % 400) ELSE o.t END AS b,
   CASE WHEN o.k % 23 <> 0 THEN o.t + 86400 * 350 END AS x, CASE WHEN o.k % 8 = 0 THEN o.t + 86400 * 200 END AS e, p.t AS rt, CASE WHEN o.k % 4 = 0 THEN o.k - 8 ELSE o.k - 7 END % 3 AS rs,
   CASE WHEN o.k % 13 = 0 OR o.k % 17 = 0 THEN NULL ELSE s[o.c % 57 + 1] END AS s1, CASE WHEN o.k % 2 = 0 THEN f[lpad(CAST(o.c % 57 AS VARCHAR), 2, '0')] END AS s2, o.k % 2 = 0 AS two FROM o LEFT JOIN o p ON p.k = o.k - 7, st),
 v AS (SELECT *, kind <> 'Alert' AND rt IS NOT NULL AS refs, CASE WHEN kind = 'Cancel' THEN rt IS NOT NULL ELSE coalesce(x > b AND (e IS NULL OR e >= b), false) END AS valid FROM m)"""


@query("cap_messages", CAP + """ SELECT CAST(k AS VARCHAR) AS message_id, CASE WHEN t > 946684800 THEN 'active' ELSE 'history' END AS lanes, kind AS message_type, actual, t AS sent, b AS effective, x AS expires, e AS ends, CAST(CASE WHEN refs THEN 1 ELSE 0 END AS BIGINT) AS n_references,
 array_to_string(list_sort(list_distinct(list_filter([s1, s2], lambda s: s IS NOT NULL))), ',') AS state_codes, s1 IS NULL OR (two AND s2 IS NULL) AS unresolved, valid AS timing_valid FROM v""")
def cap_messages(spark, sf_dir):
    """Identity, timing and states of all messages."""
    m = cap.cap_messages(features(spark, sf_dir))
    return m.select("message_id", F.array_join("lanes", ",").alias("lanes"), "message_type", "actual", "sent", "effective", "expires", "ends", F.size("references").cast("long").alias("n_references"), F.array_join("state_codes", ",").alias("state_codes"), "unresolved", "timing_valid")


STATES_AT = CAP + f""", ct AS (SELECT r.k, min(v.t) FILTER (v.kind = 'Cancel') AS can, min(v.t) FILTER (v.kind = 'Update') AS sup FROM v JOIN v r ON r.k = v.k - 7 AND v.rs = r.k % 3 AND v.t >= r.t WHERE v.refs AND v.actual GROUP BY 1),
 g AS (SELECT i AS mo FROM generate_series({START}, {END}, {STEP}) u(i)),
 sa AS (SELECT CAST(v.k AS VARCHAR) AS message_id, mo AS t, CASE WHEN mo >= can OR (kind = 'Cancel' AND valid AND rt <= v.t) THEN 'cancelled' WHEN mo >= sup THEN 'superseded' WHEN NOT valid OR kind = 'Cancel' THEN 'unverified' WHEN x <= mo OR e <= mo THEN 'expired' WHEN b > mo THEN 'upcoming' ELSE 'active' END AS status
   FROM v JOIN g ON v.t <= mo LEFT JOIN ct USING (k) WHERE actual)"""


@query("official_states", STATES_AT + " SELECT * FROM sa")
def official_states(spark, sf_dir):
    """The state of every message at every half year."""
    return official.status_at(official.status_intervals(cap.cap_messages(features(spark, sf_dir))), START, END, STEP)


@query("official_state_counts", STATES_AT + " SELECT t, status, count(*) AS n FROM sa GROUP BY 1, 2")
def official_state_counts(spark, sf_dir):
    """How many messages are in each state at every half year."""
    return official.status_counts(official.status_intervals(cap.cap_messages(features(spark, sf_dir))), START, END, STEP)
