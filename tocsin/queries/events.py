"""Queries on the event stream: slots, baselines, takeoffs, cumulative sums, sequences, joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.stats import nearest_rank, quantile, robust_by, robust_sigma
from ..functions.timeutil import day_of, half_hour_floor, slot_of_day, unix
from ..operators import joins, sequences, tables
from ..plans import alerts, backtest, baseline, detectors, expectation
from . import alarm_oracle, query, r6, with_

WS = "((slot // 86400 + 4) % 7) * 48 + (slot % 86400) // 1800"
#: M1 and M7 in SQL: scored slots.
SCORED = f"""+ x AS (SELECT slot, CAST(n AS DOUBLE) AS actual, {WS} AS ws FROM s),
 md AS (SELECT ws, median(actual) AS med FROM x GROUP BY 1),
 bs AS (SELECT x.ws, any_value(med) AS med, 1.4826 * median(abs(actual - med)) AS mad FROM x JOIN md USING (ws) GROUP BY 1),
 sc AS (SELECT slot, actual, CASE WHEN (SELECT count(*) FROM s) >= 336 THEN med ELSE actual END AS expected, CASE WHEN (SELECT count(*) FROM s) >= 336 THEN mad ELSE 0 END AS std FROM x JOIN bs USING (ws)),
 rs AS (SELECT *, actual - expected AS d, (actual - expected) / greatest(expected, 1) AS r FROM sc),
 cal AS (SELECT coalesce(median(CASE WHEN d <> 0 THEN abs(d) END), median(std), 0) AS floor_, median(CASE WHEN d > 0 THEN d END) AS up,
  coalesce(median(abs(r)), median(std), 0) AS r_floor, median(CASE WHEN r > 0 THEN r END) AS r_up FROM rs),
 sg AS (SELECT slot, actual, expected, std, d, CASE WHEN greatest(std, floor_) > 0 THEN d / greatest(std, floor_) ELSE 0 END AS v,
  CASE WHEN d > 0 THEN d / (d + coalesce(up, floor_)) ELSE 1 END AS w FROM rs, cal),
 scored AS (SELECT slot, actual, expected, std, d AS divergence, CASE WHEN v > 0 THEN v * w ELSE v END AS sigma FROM sg)"""
SCORED_WITH = with_("e s", SCORED)


def scores(spark, sf_dir):
    return baseline.weekslot_scores(A.slot_counts(spark, sf_dir))


@query("slot_counts", with_("e s", "SELECT slot, n FROM s"))
def slot_counts(spark, sf_dir):
    return A.slot_counts(spark, sf_dir)


@query("slot_counts_dense", with_("e s", "SELECT g.slot, coalesce(s.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(slot) FROM s), (SELECT max(slot) FROM s), 1800)) AS slot) g LEFT JOIN s USING (slot)"))
def slot_counts_dense(spark, sf_dir):
    s = A.slot_counts(spark, sf_dir)
    return s.unionByName(tables.missing_steps(s, "slot", 1800).withColumn("n", F.lit(0).cast("long")))


@query("missing_slots", with_("e s", "SELECT g.slot FROM (SELECT unnest(generate_series((SELECT min(slot) FROM s), (SELECT max(slot) FROM s), 1800)) AS slot) g ANTI JOIN s USING (slot)"))
def missing_slots(spark, sf_dir):
    return tables.missing_steps(A.slot_counts(spark, sf_dir), "slot", 1800)


@query("daily_rollup", with_("e s", "SELECT a.day, users, peak, samples FROM (SELECT t // 86400 AS day, count(DISTINCT user_id) AS users FROM e GROUP BY 1) a JOIN (SELECT slot // 86400 AS day, max(n) AS peak, count(*) AS samples FROM s GROUP BY 1) b USING (day)"))
def daily_rollup(spark, sf_dir):
    users = A.events(spark, sf_dir).groupBy(day_of("t").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return users.join(A.slot_counts(spark, sf_dir).groupBy(day_of("slot").alias("day")).agg(F.max("n").alias("peak"), F.count("*").alias("samples")), "day")


@query("weekslot_baseline", with_("e s", f"+ x AS (SELECT CAST({WS} AS BIGINT) AS week_slot, CAST(n AS DOUBLE) AS x FROM s), m AS (SELECT week_slot, count(*) AS n, median(x) AS med FROM x GROUP BY 1) SELECT week_slot, m.n, m.med, round(1.4826 * median(abs(x - m.med)), 6) AS mad FROM x JOIN m USING (week_slot) GROUP BY 1, 2, 3"))
def weekslot_baseline(spark, sf_dir):
    return baseline.weekslot_baseline(A.slot_counts(spark, sf_dir)).withColumn("mad", r6("mad"))


@query("weekslot_scores", SCORED_WITH + " SELECT slot, actual, expected, round(std, 6) AS std, divergence, round(sigma, 6) AS sigma FROM scored")
def weekslot_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("slot", "actual", "expected", r6("std").alias("std"), "divergence", r6("sigma").alias("sigma"))


@query("signal_calibration", SCORED_WITH + " SELECT 'absolute' AS model, round(floor_, 6) AS floor, round(coalesce(up, floor_), 6) AS positive_scale FROM cal UNION ALL SELECT 'relative', round(r_floor, 6), round(coalesce(r_up, r_floor), 6) FROM cal")
def signal_calibration(spark, sf_dir):
    return baseline.calibration(scores(spark, sf_dir)).select("model", r6("floor").alias("floor"), r6("positive_scale").alias("positive_scale"))


@query("alarm_threshold", SCORED_WITH + ", pk AS (SELECT slot // 86400 AS day, max(sigma) AS peak FROM scored WHERE slot // 86400 > (SELECT max(slot // 86400) FROM scored) - 365 GROUP BY 1), tp AS (SELECT peak FROM pk ORDER BY peak DESC LIMIT 2) SELECT CASE WHEN count(*) < 2 THEN 7.0 ELSE greatest(4.0, ceil((min(peak) + 0.05) * 10) / 10) END AS threshold FROM tp")
def alarm_threshold(spark, sf_dir):
    return baseline.alarm_threshold(scores(spark, sf_dir))


@query("gap_segments", with_("e", """+ d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM e),
 u AS (SELECT user_id, median(step) AS usual FROM d WHERE step > 0 GROUP BY 1),
 c AS (SELECT d.user_id, t, sum(CASE WHEN coalesce(step > greatest(86400.0, 2 * coalesce(usual, 0)), true) THEN 1 ELSE 0 END) OVER (PARTITION BY d.user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM d LEFT JOIN u USING (user_id)),
 r AS (SELECT user_id, island, min(t) AS a, max(t) AS b, count(*) AS n FROM c GROUP BY 1, 2)
 SELECT user_id, a AS segment_start, b AS segment_end, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, b DESC, a DESC) AS k FROM r) WHERE k = 1"""))
def gap_segments(spark, sf_dir):
    return sequences.gap_segments(A.events(spark, sf_dir), "user_id", "t")


@query("decayed_mean_slot", with_("e s", """+ x AS (SELECT (slot % 86400) // 1800 AS own, CAST(n AS DOUBLE) AS x, (SELECT max(slot // 86400) FROM s) - slot // 86400 AS age FROM s),
 y AS (SELECT CAST((own + d + 48) % 48 AS BIGINT) AS slot_of_day, x, exp(-ln(2) / 2 * age) AS w FROM x, (VALUES (-1), (0), (1)) v(d))
 SELECT slot_of_day, count(*) AS n, round(sum(w * x) / sum(w), 6) AS expected FROM y GROUP BY 1"""))
def decayed_mean_slot(spark, sf_dir):
    return baseline.decayed_slots(A.slot_counts(spark, sf_dir)).withColumn("expected", r6("expected"))


def expectation_sql(rows: str, annual: bool, digits: int = 6) -> str:
    """The model by plain self joins of rows (series, slot, n)."""
    def around(src, x, tag):  # decayed means and roots of mean squares by side, then over sides
        one = lambda h, k, same, v: f"sum({v} * exp(-ln(2) / {h} * age)) FILTER (side = {k}{' AND same' if same else ''}) / sum(exp(-ln(2) / {h} * age)) FILTER (side = {k}{' AND same' if same else ''})"
        cols = ", ".join(f"list_avg(list_filter([{', '.join(('sqrt(' + one(h, k, same, 'x * x') + ')') if p else one(h, k, same, 'x') for k in (-1, 0, 1))}], lambda v: v IS NOT NULL)) AS {'rms' if p else 'mean'}_{t}" for t, h, same in (("d", 2, False), ("w", 3, True)) for p in (0, 1))
        return f"""{tag} AS (SELECT series, slot, count(*) FILTER (same) AS n_w, {cols} FROM (SELECT a.series, a.slot, b.{x} AS x, (a.slot - b.slot) / 86400.0 AS age, (a.slot // 86400) % 7 = (b.slot // 86400) % 7 AS same,
   CASE WHEN (b.slot // 1800 - a.slot // 1800) % 48 IN (1, -47) THEN 1 WHEN (b.slot // 1800 - a.slot // 1800) % 48 IN (-1, 47) THEN -1 ELSE 0 END AS side
   FROM {src} a JOIN {src} b ON a.series = b.series AND b.slot >= a.slot - 2419200 AND b.slot < a.slot AND abs(b.slot // 1800 - a.slot // 1800) % 48 IN (0, 1, 47) WHERE b.{x} IS NOT NULL) GROUP BY 1, 2)"""
    blend = lambda d, w: f"CASE WHEN {d} IS NOT NULL AND {w} IS NOT NULL THEN (1 - n_w / (n_w + 2.0)) * {d} + n_w / (n_w + 2.0) * {w} ELSE coalesce({d}, {w}) END"
    years = """, ye AS (SELECT series, slot AS goal, n / base AS ratio FROM b0 WHERE ready AND base > 0),
 ta AS (SELECT series, slot, base, CAST(epoch(make_date(year(stamp) - y, month(stamp), 1)) AS BIGINT) + 86400 * (day(stamp) - 1 + dd) + slot % 86400 + 1800 * ss AS goal, exp(-ln(2) / 2 * (y - 1)) * exp(-0.5 * pow(dd / 1.25, 2)) * exp(-0.5 * pow(ss / 3.125, 2)) AS g
   FROM (SELECT *, make_timestamp(slot * 1000000) AS stamp FROM b0 WHERE base > 0), generate_series(1, 3) t1(y), generate_series(-2, 2) t2(dd), generate_series(-5, 5) t3(ss)),
 yr AS (SELECT series, slot, base * (greatest(0.25, least(2.25, sum(g * ratio) / sum(g))) - 1) AS a, sum(g) / (sum(g) + 1) AS b FROM ta JOIN ye USING (series, goal) GROUP BY 1, 2, base)""" if annual else ""
    a, w = ("coalesce(yr.a, adjustment, 0)", "coalesce(yr.b, weight, 0)") if annual else ("coalesce(adjustment, 0)", "coalesce(weight, 0)")
    return rows + f""", {around("q", "n", "m0")},
 b0 AS (SELECT *, coalesce({blend("mean_d", "mean_w")}, n) AS base, k > 336 AND n_w IS NOT NULL AS ready FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY slot) AS k FROM q) LEFT JOIN m0 USING (series, slot)),
 dy AS (SELECT series, slot // 86400 AS day, min(slot) AS past, avg(n - base) FILTER (ready) AS residual, count(*) FILTER (ready) AS k FROM b0 GROUP BY 1, 2),
 ca AS (SELECT series, slot, sum(g * residual) / sum(g) AS adjustment, sum(g) / (sum(g) + 2) AS weight FROM (SELECT b0.series, b0.slot, residual, exp(-0.5 * pow(dist / 2.5, 2)) * exp(-ln(2) / 732 * (b0.slot - past) / 86400.0) * CASE WHEN day % 7 = (b0.slot // 86400) % 7 THEN 1 ELSE 0.6 END * greatest(1, sqrt(dy.k)) AS g
   FROM b0 JOIN dy ON b0.series = dy.series AND b0.slot - past BETWEEN 180 * 86400 AND 1098 * 86400,
   LATERAL (SELECT least(abs(i), 366 - abs(i)) AS dist FROM (SELECT dayofyear(make_timestamp(b0.slot * 1000000)) - dayofyear(make_timestamp(past * 1000000)) AS i)) WHERE residual IS NOT NULL AND dist <= 7) GROUP BY 1, 2){years},
 x0 AS (SELECT b0.*, {a} AS adj, {w} AS wt FROM b0 LEFT JOIN ca USING (series, slot){" LEFT JOIN yr USING (series, slot)" if annual else ""}),
 x1 AS (SELECT *, CASE WHEN ready THEN base + adj * wt ELSE n END AS expected, CASE WHEN ready THEN n - base - adj * wt END AS residual FROM x0),
 {around("x1", "residual", "m1")}
 SELECT series, slot, CAST(n AS BIGINT) AS n, round(base, {digits}) AS base, CASE WHEN round(adj, {digits}) = 0 THEN 0.0 ELSE round(adj, {digits}) END AS adjustment, round(wt, {digits}) AS weight, round(expected, {digits}) AS expected, ready,
  round(CASE WHEN ready THEN greatest(8, coalesce({blend("coalesce(m1.rms_d, x1.rms_d)", "coalesce(m1.rms_w, x1.rms_w)").replace("n_w", "x1.n_w")}, 8)) ELSE 8 END, {digits}) AS std FROM x1 LEFT JOIN m1 USING (series, slot)"""


def expected_columns(df):
    """Rounded; a residue of minus nothing is nothing."""
    r = {c: r6(c) for c in ("base", "adjustment", "weight", "expected", "std")}
    return df.select("series", "slot", "n", *[F.when(x == 0, 0.0).otherwise(x).alias(c) for c, x in r.items()], "ready")


@query("causal_expectation", expectation_sql(with_("e s", "+ q AS (SELECT 'all' AS series, slot, CAST(n AS DOUBLE) AS n FROM s)"), False))
def causal_expectation(spark, sf_dir):
    return expected_columns(expectation.causal_expectation(A.slot_counts(spark, sf_dir)))


#: Orders of six years, dealt by their numbers to six half hours of the day.
ORDER_SLOTS = "WITH q AS (SELECT CAST(o_orderkey % 2 AS VARCHAR) AS series, CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 86400 + 1800 * ((o_orderkey // 2) % 6) AS slot, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2)"


def order_slots(spark, sf_dir):
    slot = F.floor(unix("o_orderdate") / 86400) * 86400 + 1800 * (F.floor(F.col("o_orderkey") / 2) % 6)
    return A.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 2).alias("half"), slot.alias("slot")).agg(F.count("*").alias("n"))


@query("calendar_expectation", expectation_sql(ORDER_SLOTS, False))
def calendar_expectation(spark, sf_dir):
    """Two series with residuals of the same time of the year, up to three years before."""
    return expected_columns(expectation.causal_expectation(order_slots(spark, sf_dir), "half"))


@query("prior_year_expectation", expectation_sql(ORDER_SLOTS, True))
def prior_year_expectation(spark, sf_dir):
    """The same with the smoothed ratios of prior years."""
    return expected_columns(expectation.causal_expectation(order_slots(spark, sf_dir), "half", annual=True))


@query("takeoff_transitions", with_("e o tk", "SELECT hex, t, event_id, previous FROM tk"))
def takeoff_transitions(spark, sf_dir):
    return A.takeoffs(spark, sf_dir).select("hex", "t", "event_id", "previous")


def takeoff_counts(spark, sf_dir):
    return detectors.takeoff_slots(A.slot_counts(spark, sf_dir), A.takeoffs(spark, sf_dir))


COUNTS = """+ tc AS (SELECT s.slot, coalesce(k.n, 0) AS n, CASE WHEN (s.slot // 86400 + 4) % 7 IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_class, CAST((s.slot % 86400) // 1800 AS BIGINT) AS slot_of_day
  FROM s LEFT JOIN (SELECT t - t % 1800 AS slot, count(*) AS n FROM tk GROUP BY 1) k USING (slot)),
 ma AS (SELECT day_class, slot_of_day, median(n) AS med FROM tc GROUP BY 1, 2), mb AS (SELECT slot_of_day, median(n) AS med FROM tc GROUP BY 1), mc AS (SELECT median(n) AS med FROM tc),
 ba AS (SELECT day_class, slot_of_day, count(*) AS n, (sum(least(n, med + 4 * sqrt(greatest(med, 1)))) + 0.5) / count(*) AS mean FROM tc JOIN ma USING (day_class, slot_of_day) GROUP BY 1, 2),
 bb AS (SELECT slot_of_day, count(*) AS n, (sum(least(n, med + 4 * sqrt(greatest(med, 1)))) + 0.5) / count(*) AS mean FROM tc JOIN mb USING (slot_of_day) GROUP BY 1),
 bc AS (SELECT count(*) AS n, (sum(least(n, med + 4 * sqrt(greatest(med, 1)))) + 0.5) / count(*) AS mean FROM tc, mc),
 bl AS (SELECT ba.day_class, ba.slot_of_day, CASE WHEN ba.n >= 6 THEN ba.n WHEN bb.n >= 6 THEN bb.n ELSE bc.n END AS n, CASE WHEN ba.n >= 6 THEN ba.mean WHEN bb.n >= 6 THEN bb.mean ELSE bc.mean END AS mean,
  CASE WHEN ba.n >= 6 THEN 'class' WHEN bb.n >= 6 THEN 'slot' ELSE 'global' END AS tier FROM ba JOIN bb USING (slot_of_day), bc),
 dg AS (SELECT count(*) AS k, avg(n) AS m, var_pop(n) AS v FROM tc GROUP BY day_class, slot_of_day HAVING count(*) >= 3 AND avg(n) > 0),
 dp AS (SELECT greatest(1.0, coalesce(sum(k * v / m) / sum(k - 1), 1.0)) AS d FROM dg)"""
COUNTS_WITH = with_("e s o tk", COUNTS)


@query("takeoff_baseline", COUNTS_WITH + " SELECT day_class, slot_of_day, n, round(mean, 6) AS mean, tier FROM bl")
def takeoff_baseline(spark, sf_dir):
    return detectors.takeoff_baseline(takeoff_counts(spark, sf_dir)).withColumn("mean", r6("mean"))


TAIL = """, q AS (SELECT slot, tc.n, mean, d FROM tc JOIN bl USING (day_class, slot_of_day), dp),
 tl AS (SELECT slot, n, mean, d, CASE WHEN n <= 0 THEN 1.0 ELSE least(1.0, (SELECT sum(CASE WHEN d <= 1 + 1e-6 THEN exp((n + j) * ln(mean) - mean - lgamma(n + j + 1))
  ELSE exp(lgamma(mean / (d - 1) + n + j) - lgamma(mean / (d - 1)) - lgamma(n + j + 1) - mean / (d - 1) * ln(d) + (n + j) * ln((d - 1) / d)) END) FROM (SELECT unnest(generate_series(0, 400)) AS j))) END AS tail FROM q)"""


@query("takeoff_surprise", COUNTS_WITH + TAIL + """ SELECT slot, n, round(mean, 6) AS mean, round(d, 6) AS dispersion, round(-log10(greatest(tail, 1e-300)), 6) AS surprise FROM tl""")
def takeoff_surprise(spark, sf_dir):
    out = detectors.takeoff_surprise(takeoff_counts(spark, sf_dir))
    return out.select("slot", "n", r6("mean").alias("mean"), r6("dispersion").alias("dispersion"), F.abs(r6("surprise")).alias("surprise"))


@query("surprise_ladder", COUNTS_WITH + TAIL + """, sp AS (SELECT slot, -log10(greatest(tail, 1e-300)) AS surprise FROM tl), pa AS (SELECT surprise, row_number() OVER (ORDER BY surprise DESC) AS k, count(*) OVER () AS n FROM sp WHERE slot >= 1706659200 - 365 * 86400 AND slot < 1706659200)
 SELECT tier, round(log10(17520 / b), 6) AS model, round(least(surprise, log10(17520 / b) + 2), 6) AS record FROM (VALUES ('elevated', 12), ('high', 4), ('critical', 1)) v(tier, b) JOIN pa ON k = greatest(floor(b * n / 17520), 1) WHERE n >= 336""")
def surprise_ladder(spark, sf_dir):
    ladder = detectors.surprise_ladder(detectors.takeoff_surprise(takeoff_counts(spark, sf_dir)), 1706659200, 336)
    return ladder.select("tier", r6("model").alias("model"), F.abs(r6("record")).alias("record"))


def series_z(spark, sf_dir):
    c = A.slot_counts_by(spark, sf_dir).withColumn("x", F.col("n").cast("double"))
    b = robust_by(c, ["series"], "x").drop("n")
    return c.join(b, "series").withColumn("z", (F.col("x") - F.col("med")) / robust_sigma("mad", "med"))


Z = """+ c AS (SELECT event_type AS series, t - t % 1800 AS slot, CAST(count(*) AS DOUBLE) AS x FROM e GROUP BY 1, 2), m AS (SELECT series, median(x) AS med FROM c GROUP BY 1),
 b AS (SELECT c.series, any_value(med) AS med, 1.4826 * median(abs(x - med)) AS mad FROM c JOIN m USING (series) GROUP BY 1),
 z AS (SELECT series, slot, (x - med) / greatest(mad, sqrt(greatest(med, 1)), 1) AS z FROM c JOIN b USING (series))"""


@query("cusum_series", with_("e", Z + ", k AS (SELECT series, slot, z, sum(greatest(-4, least(8, z)) - 0.5) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING) AS c FROM z) SELECT series, slot, round(c - least(0, min(c) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING)), 6) AS s FROM k"))
def cusum_series(spark, sf_dir):
    return sequences.cusum(series_z(spark, sf_dir), "series", "slot", F.col("z"), 0.5).select("series", "slot", r6("s").alias("s"))


@query("cusum_crossings", alarm_oracle("e", Z + ", q AS (SELECT series, slot, 0 AS tie, z * 3 AS z FROM z)", "round(s, 6)"))
def cusum_crossings(spark, sf_dir):
    return sequences.cusum_crossings(series_z(spark, sf_dir).withColumn("z", F.col("z") * 3), "series", "slot", "z").withColumn("s", r6("s"))


@query("healthy_slots", with_("e", "SELECT t - t % 1800 AS slot, count(*) AS total FROM e GROUP BY 1 HAVING count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN event_type END) = 2"))
def healthy_slots(spark, sf_dir):
    return detectors.healthy_slots(A.slot_counts_by(spark, sf_dir), ["view", "click"])


@query("void_detector", with_("e", """+ h AS (SELECT DISTINCT t - t % 3600 AS hour FROM e), c AS (SELECT event_type AS series, t - t % 3600 AS hour, count(*) AS n FROM e GROUP BY 1, 2),
 f AS (SELECT sr.series, h.hour, coalesce(c.n, 0) AS n FROM h CROSS JOIN (SELECT DISTINCT event_type AS series FROM e) sr LEFT JOIN c ON c.series = sr.series AND c.hour = h.hour),
 p AS (SELECT a.series, a.hour, a.n, CAST(b.n AS DOUBLE) AS x FROM f a JOIN f b ON a.series = b.series AND (a.hour // 3600) % 24 = (b.hour // 3600) % 24 AND b.hour BETWEEN a.hour - 21 * 86400 AND a.hour - 1),
 m AS (SELECT series, hour, median(x) AS med FROM p GROUP BY 1, 2 HAVING count(*) >= 10),
 b AS (SELECT p.series, p.hour, any_value(n) AS n, any_value(med) AS med, 1.4826 * median(abs(x - med)) AS mad FROM p JOIN m USING (series, hour) GROUP BY 1, 2),
 z AS (SELECT series, hour, n, med, (n - med) / greatest(mad, sqrt(greatest(med, 1)), 1, 2.0) AS z FROM b WHERE med >= 2),
 v AS (SELECT *, n <= 0.25 * med OR z <= -5 AS void FROM z), k AS (SELECT *, sum(CASE WHEN void THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM v)
 SELECT series, hour, n, med, round(z, 6) AS z, void, CAST(sum(CASE WHEN void THEN 1 ELSE 0 END) OVER (PARTITION BY series, run ORDER BY hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM k"""))
def void_detector(spark, sf_dir):
    e = A.events(spark, sf_dir).withColumn("hour", F.col("t") - F.pmod("t", F.lit(3600)))
    counts = e.groupBy(F.col("event_type").alias("series"), "hour").agg(F.count("*").alias("n"))
    return detectors.voids(counts, e.select("hour").distinct(), typical=2.0).select("series", "hour", "n", "med", r6("z").alias("z"), "void", "streak")


@query("json_props", with_("e", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY 1, 2"))
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return A.events(spark, sf_dir).groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("asof_prev_30m", with_("e", "SELECT a.event_id, max(b.t) AS previous_t, max(struct_pack(t := b.t, i := b.event_id)).i AS previous_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t - 1800 GROUP BY 1"))
def asof_prev_30m(spark, sf_dir):
    out = joins.asof_backward(A.events(spark, sf_dir), "user_id", "t", ["event_id"], "event_id", 1800)
    return out.filter("previous is not null").select("event_id", F.col("previous.t").alias("previous_t"), F.col("previous.v").alias("previous_id"))


@query("asof_nearest", with_("e s", "SELECT event_id, slot, n FROM (SELECT event_id, slot, n, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - slot), slot) AS k FROM e JOIN s ON slot BETWEEN t - 1200 AND t + 1200) WHERE k = 1"))
def asof_nearest(spark, sf_dir):
    e = A.events(spark, sf_dir).select("event_id", "t")
    return joins.asof_nearest(e, A.slot_counts(spark, sf_dir), "t", "slot", 1200, "event_id").select("event_id", "slot", "n")


@query("topk_prefix", "SELECT substr(event_type, 1, 2) || CAST(user_id % 50 AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def topk_prefix(spark, sf_dir):
    return tables.top_counts(A.events(spark, sf_dir), F.concat(F.substring("event_type", 1, 2), (F.col("user_id") % 50).cast("string")), 20)


@query("path_last6", with_("e", "SELECT user_id, event_id, t, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS k FROM e) WHERE k <= 6"))
def path_last6(spark, sf_dir):
    return tables.last_n(A.events(spark, sf_dir), "user_id", [F.desc("t"), F.desc("event_id")], 6, "place").select("user_id", "event_id", "t", "place")


@query("rle_deltas", with_("e", """+ c AS (SELECT event_type AS series, t - t % 1800 AS slot FROM e GROUP BY 1, 2), d AS (SELECT series, slot, slot - coalesce(lag(slot) OVER (PARTITION BY series ORDER BY slot), slot) AS delta FROM c),
 f AS (SELECT *, delta IS DISTINCT FROM lag(delta) OVER (PARTITION BY series ORDER BY slot) OR lag(slot) OVER (PARTITION BY series ORDER BY slot) IS NULL AS new FROM d),
 g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM f)
 SELECT series, CAST(run AS BIGINT) AS run, delta, count(*) AS n, min(slot) AS first FROM g GROUP BY 1, 2, 3"""))
def rle_deltas(spark, sf_dir):
    c = A.slot_counts_by(spark, sf_dir).select("series", "slot")
    d = c.withColumn("delta", F.col("slot") - F.coalesce(F.lag("slot").over(sequences.by("series", "slot")), "slot"))
    return sequences.run_lengths(d, "series", "slot", "delta")


@query("burst_windows", SCORED_WITH + """, r AS (SELECT slot // 86400 AS day, slot, divergence AS x, row_number() OVER w AS pos, lag(divergence) OVER w AS weak, greatest(2.0, 0.3 * max(divergence) OVER (PARTITION BY slot // 86400)) AS line FROM scored WINDOW w AS (PARTITION BY slot // 86400 ORDER BY slot)),
 g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY day ORDER BY slot) AS step FROM r WHERE x >= line), h AS (SELECT *, step = 1 OR (step = 2 AND weak >= 0) AS on_, CASE WHEN step = 2 AND weak >= 0 THEN weak ELSE 0 END AS bridge FROM g),
 b AS (SELECT *, sum(CASE WHEN coalesce(on_, false) THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS burst FROM h), t AS (SELECT day, burst, min(slot) AS burst_start, max(slot) AS burst_end, sum(x + bridge) AS total FROM b GROUP BY 1, 2)
 SELECT day, burst_start, burst_end, total FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, burst_start) AS k FROM t) WHERE k = 1""")
def burst_windows(spark, sf_dir):
    s = scores(spark, sf_dir).select(day_of("slot").alias("day"), "slot", F.col("divergence").alias("residual"))
    return sequences.best_burst(s, "day", "slot", "residual", least=2.0)


@query("baseline_dates", SCORED_WITH + """, d AS (SELECT slot // 86400 AS day, count(*) AS k, avg(abs(divergence)) AS score FROM scored GROUP BY 1 HAVING count(*) >= 40), t AS (SELECT DISTINCT slot // 86400 AS target_day FROM scored)
 SELECT target_day, day, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_day ORDER BY score, day) AS rank FROM t JOIN d ON target_day % 7 = day % 7 AND abs(day - target_day) >= 21) WHERE rank <= 4""")
def baseline_dates(spark, sf_dir):
    s = scores(spark, sf_dir).select(day_of("slot").alias("day"), F.col("divergence").alias("residual"))
    return detectors.quiet_dates(s, s.select(F.col("day").alias("target_day")).distinct()).withColumn("score", r6("score"))


@query("excess_origins", with_("e s", """+ j AS (SELECT a.slot, a.n, CAST(b.n AS DOUBLE) AS x FROM s a JOIN s b ON a.slot % 604800 = b.slot % 604800 AND abs(a.slot - b.slot) BETWEEN 864000 AND 15724800),
 m AS (SELECT slot, median(x) AS med FROM j GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT slot, any_value(n) AS n, any_value(med) AS med, 1.4826 * median(abs(x - med)) AS mad FROM j JOIN m USING (slot) GROUP BY 1)
 SELECT slot, n - med AS residual, round((n - med) / greatest(mad, 1), 6) AS z FROM b"""))
def excess_origins(spark, sf_dir):
    return detectors.excess_origins(A.slot_counts(spark, sf_dir), least=2).withColumn("z", r6("z"))


@query("rolling_distinct_1h", with_("e", "SELECT event_id, user_id, t, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING))) AS kinds FROM e QUALIFY kinds >= 3"))
def rolling_distinct_1h(spark, sf_dir):
    out = sequences.rolling_distinct(A.events(spark, sf_dir), "user_id", "t", "event_type", 3600, "kinds")
    return out.filter("kinds >= 3").select("event_id", "user_id", "t", "kinds")


@query("hour_overlap_weights", with_("e", "+ w AS (SELECT event_id, t AS a, t + 5400 AS b FROM e WHERE event_type = 'purchase'), h AS (SELECT *, unnest(generate_series(a // 3600, (b - 1) // 3600)) AS hour FROM w) SELECT hour, count(*) AS n, round(sum((least(b, (hour + 1) * 3600) - greatest(a, hour * 3600)) / 3600.0), 6) AS weight FROM h GROUP BY 1"))
def hour_overlap_weights(spark, sf_dir):
    w = A.events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", F.col("t").alias("a"), (F.col("t") + 5400).alias("b"))
    return sequences.hour_overlaps(w, "a", "b").groupBy("hour").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("weight"))


@query("data_quality", with_("e s", "+ lv AS (SELECT DISTINCT t - t % 1800 AS slot FROM e WHERE event_type = 'view'), p AS (SELECT a.slot, count(*) AS k, median(CAST(b.n AS DOUBLE)) AS med FROM s a JOIN s b ON a.slot % 86400 = b.slot % 86400 AND b.slot BETWEEN a.slot - 14 * 86400 AND a.slot - 1 AND b.slot IN (FROM lv) GROUP BY 1) SELECT s.slot, s.n, CASE WHEN s.slot NOT IN (FROM lv) THEN 'stale_live' WHEN coalesce(k, 0) < 8 THEN 'unknown' WHEN s.n < 0.6 * med THEN 'degraded' ELSE 'ok' END AS status FROM s LEFT JOIN p USING (slot)"))
def data_quality(spark, sf_dir):
    """A slot is live if it has a view."""
    return detectors.data_quality(live_slots(spark, sf_dir))


def live_slots(spark, sf_dir):
    live = A.events(spark, sf_dir).filter("event_type = 'view'").select(half_hour_floor("t").alias("slot")).distinct().withColumn("live", F.lit(True))
    return A.slot_counts(spark, sf_dir).join(live, "slot", "left")


@query("model_errors", SCORED_WITH + " SELECT count(*) AS n, round(avg(abs(actual - expected)), 6) AS mae, round(sqrt(avg((actual - expected) * (actual - expected))), 6) AS rmse, round(avg(actual - expected), 6) AS bias FROM scored")
def model_errors(spark, sf_dir):
    return alerts.error_metrics(scores(spark, sf_dir)).select("n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("bias").alias("bias"))


@query("coverage_status", with_("e", "+ c AS (SELECT event_type AS series, t - t % 1800 AS slot FROM e), g AS (SELECT series, count(DISTINCT slot) AS samples, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY 1) SELECT series, samples, 1706659200 - hi AS age, round(samples / ((hi - lo) / 1800 + 1), 6) AS completeness, CASE WHEN samples < 48 THEN 'warming' WHEN 1706659200 - hi > 5400 THEN 'stale' WHEN samples / ((hi - lo) / 1800 + 1) < 0.98 THEN 'degraded' ELSE 'ok' END AS status FROM g"))
def coverage_status(spark, sf_dir):
    c = A.events(spark, sf_dir).select(F.col("event_type").alias("series"), half_hour_floor("t").alias("slot"))
    return alerts.coverage(c, 1706659200, 1800).withColumn("completeness", r6("completeness"))


@query("replay_frequency", SCORED_WITH + " SELECT CASE WHEN sigma >= 7 THEN 5 ELSE least(4, floor(4 * greatest(sigma, 0) / 7) + 1) END::BIGINT AS level, count(*) AS n, count(DISTINCT slot // 86400) AS days FROM scored GROUP BY 1")
def replay_frequency(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct(day_of("slot")).alias("days"))


@query("injection_replay")
def injection_replay(spark, sf_dir):
    """Levels of the last four slots, as they are and with counts times three."""
    s = A.slot_counts(spark, sf_dir)
    since = s.agg((F.max("slot") - 3 * 1800).alias("since")).first().since
    real, more = (baseline.weekslot_scores(x).filter(F.col("slot") >= since).select("slot", "sigma", "level") for x in (s, alerts.injected(s, since)))
    return real.select(F.lit("real").alias("run"), "*").unionByName(more.select(F.lit("injected").alias("run"), "*"))


@query("sessions_45m", with_("e", "+ d AS (SELECT user_id, t, event_id, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 2700, true) AS new FROM e), c AS (SELECT user_id, t, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM d) SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS first, max(t) AS last, count(*) AS n FROM c GROUP BY 1, 2"))
def sessions_45m(spark, sf_dir):
    s = sequences.sessions(A.events(spark, sf_dir), "user_id", "t", ["t", "event_id"], 2700)
    return s.groupBy("user_id", "session").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


QUALITY = """, lv AS (SELECT DISTINCT t - t % 1800 AS slot FROM e WHERE event_type = 'view'), qp AS (SELECT a.slot, count(*) AS k, median(CAST(b.n AS DOUBLE)) AS med FROM s a JOIN s b ON a.slot % 86400 = b.slot % 86400 AND b.slot BETWEEN a.slot - 14 * 86400 AND a.slot - 1 AND b.slot IN (FROM lv) GROUP BY 1),
 dq AS (SELECT s.slot, CASE WHEN s.slot NOT IN (FROM lv) THEN 'stale_live' WHEN coalesce(k, 0) < 8 THEN 'unknown' WHEN s.n < 0.6 * med THEN 'degraded' ELSE 'ok' END AS quality FROM s LEFT JOIN qp USING (slot))"""
SP = "-log10(greatest(tail, 1e-300))"
ALERTS = f""", al6 AS (SELECT scored.slot, CASE WHEN sigma >= 7 THEN 5 ELSE least(4, floor(4 * greatest(sigma, 0) / 7) + 1) END + 1 AS level, quality, tl.n AS takeoffs, mean, {SP} AS surprise FROM scored JOIN tl USING (slot) JOIN dq USING (slot)),
 u6 AS (SELECT *, quality NOT IN ('degraded', 'stale_live') AND surprise >= 2 AS unusual FROM al6),
 sv AS (SELECT *, CASE WHEN level >= 5 THEN 'critical' WHEN level = 4 THEN 'high' WHEN level = 3 THEN 'elevated' ELSE 'watch' END AS sev, CASE WHEN takeoffs >= greatest(3, 3 * mean) THEN CASE WHEN surprise > 4 THEN 'critical' WHEN surprise > 3 THEN 'high' WHEN surprise > 2.5 THEN 'elevated' ELSE 'watch' END ELSE 'watch' END AS tier FROM u6)
 SELECT 'data_quality:all:' || slot AS event_key, 'data_quality' AS kind, 'watch' AS severity, slot AS t, 'observed' AS status FROM sv WHERE quality = 'degraded' UNION ALL
 SELECT 'takeoff_batch:all:' || slot, 'takeoff_batch', 'watch', slot, 'observed' FROM sv WHERE takeoffs >= 3 UNION ALL
 SELECT 'takeoff_rate_anomaly:all:' || slot, 'takeoff_rate_anomaly', tier, slot, 'pending' FROM sv WHERE unusual UNION ALL
 SELECT 'statistical_anomaly:all:' || slot, 'statistical_anomaly', sev, slot, 'pending' FROM sv WHERE quality <> 'degraded' AND level >= 5 UNION ALL
 SELECT 'takeoff_anomaly:all:' || slot, 'takeoff_anomaly', sev, slot, 'pending' FROM sv WHERE quality <> 'degraded' AND unusual AND level >= 4"""


def judged_slots(spark, sf_dir):
    """The slots with all that the detectors say of them; levels are raised by one, so that the small tables have some."""
    s = scores(spark, sf_dir).select("slot", F.col("actual").alias("n"), "expected", "sigma", (F.col("level") + 1).alias("level"), F.lit(True).alias("ready"), F.lit(True).alias("rate_ready"))
    t = detectors.takeoff_surprise(takeoff_counts(spark, sf_dir)).select("slot", F.col("n").alias("takeoffs"), F.col("mean").alias("takeoff_mean"), "surprise")
    return s.join(t, "slot").join(detectors.data_quality(live_slots(spark, sf_dir)).select("slot", F.col("status").alias("quality")), "slot")


def fixed_ladder(spark):
    return spark.createDataFrame([("elevated", 2.5, 2.5), ("high", 3.0, 3.0), ("critical", 4.0, 4.0)], "tier string, model double, record double")


@query("alert_rows", with_("e s o tk", SCORED + ", " + COUNTS.removeprefix("+") + TAIL + QUALITY + ALERTS))
def alert_rows(spark, sf_dir):
    rows = judged_slots(spark, sf_dir).withColumn("crossing", F.lit(None).cast("string"))
    return alerts.alert_rows(rows, fixed_ladder(spark)).select("event_key", "kind", "severity", "t", "status")


@query("sustained_shifts")
def sustained_shifts(spark, sf_dir):
    """Alerts of the cumulative sum alone, the first day of each week held as a holiday that nothing has learnt."""
    rows = judged_slots(spark, sf_dir)
    z = rows.select(F.lit("all").alias("series"), "slot", (F.col("sigma") * 4).alias("z"), (F.pmod(day_of("slot"), F.lit(7)) == 0).alias("frozen"))
    crossings = sequences.cusum_crossings(z, "series", "slot", "z", frozen="frozen").select("slot", F.col("severity").alias("crossing"))
    out = alerts.alert_rows(rows.join(crossings, "slot", "left"), fixed_ladder(spark))
    return out.filter("kind = 'sustained_shift'").select("event_key", "severity", "t", "status")


@query("slot_of_day_quantiles", with_("e s", "SELECT CAST((slot % 86400) // 1800 AS BIGINT) AS slot_of_day, quantile_cont(CAST(n AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(n AS DOUBLE), 0.9) AS q90, list_sort(list(n))[CAST(ceil(0.9 * count(n)) AS INT)] AS rank90 FROM s GROUP BY 1"))
def slot_of_day_quantiles(spark, sf_dir):
    return A.slot_counts(spark, sf_dir).groupBy(slot_of_day("slot").alias("slot_of_day")).agg(quantile(F.col("n").cast("double"), 0.25).alias("q25"), quantile(F.col("n").cast("double"), 0.9).alias("q90"), nearest_rank("n", 0.9).alias("rank90"))


WALK = """+ tr AS (SELECT 'all' AS cohort, s.slot, CAST(count(tk.t) AS DOUBLE) AS x, slot % 86400 AS of_day, (s.slot // 86400 + 4) % 7 IN (0, 6) AS class, s.slot // 86400 AS day FROM s LEFT JOIN tk ON tk.t - tk.t % 1800 = s.slot
   WHERE s.slot IN (SELECT t - t % 1800 FROM e WHERE event_type = 'view') GROUP BY s.slot),
 hi AS (SELECT a.slot, a.x AS n, b.x, b.day, b.class = a.class AND b.of_day = a.of_day AS own, b.of_day = a.of_day AS same, b.class, b.of_day FROM tr a JOIN tr b ON b.slot BETWEEN a.slot - 2419200 AND a.slot - 1),
 gm AS (SELECT slot, class, of_day, median(x) AS med, count(*) AS k FROM hi GROUP BY 1, 2, 3),
 gc AS (SELECT slot, class, of_day, any_value(k) AS k, list(least(x, med + 4 * sqrt(greatest(med, 1)))) AS v FROM hi JOIN gm USING (slot, class, of_day) GROUP BY 1, 2, 3),
 gv AS (SELECT slot, k, list_avg(v) AS m, list_sum(list_transform(v, lambda y: pow(y - list_avg(v), 2))) AS q FROM gc WHERE k >= 3),
 di AS (SELECT slot, greatest(1, sum(q / m) / sum(k - 1)) AS dispersion FROM gv WHERE m > 0 GROUP BY 1),
 md AS (SELECT slot, n, count(*) AS samples, count(DISTINCT day) AS days, count(*) FILTER (own) AS ko, count(*) FILTER (same) AS ks, median(x) FILTER (own) AS mo, median(x) FILTER (same) AS ms, median(x) AS mw FROM hi GROUP BY 1, 2),
 wf AS (SELECT md.slot, md.n, samples, days, CASE WHEN ko >= 6 THEN 'class' WHEN ks >= 6 THEN 'slot' ELSE 'global' END AS tier,
  CASE WHEN ko >= 6 THEN (sum(least(x, mo + 4 * sqrt(greatest(mo, 1)))) FILTER (own) + 0.5) / ko WHEN ks >= 6 THEN (sum(least(x, ms + 4 * sqrt(greatest(ms, 1)))) FILTER (same) + 0.5) / ks ELSE (sum(least(x, mw + 4 * sqrt(greatest(mw, 1)))) + 0.5) / samples END AS mean
  FROM md JOIN hi USING (slot) GROUP BY md.slot, md.n, samples, days, ko, ks, mo, ms, mw),
 rp AS (SELECT 'all' AS cohort, slot, CAST(n AS BIGINT) AS n, mean, coalesce(dispersion, 1) AS dispersion, tier, samples, days FROM wf LEFT JOIN di USING (slot) WHERE samples >= 336 AND days >= 7)"""
#: The tail of a count by its logarithms, term by term.
TAILS = """, tp AS (SELECT *, CASE WHEN dispersion <= 1 + 1e-6 THEN i * ln(mean) - mean - lgamma(i + 1) ELSE lgamma(mean / (dispersion - 1) + i) - lgamma(mean / (dispersion - 1)) - lgamma(i + 1) - mean / (dispersion - 1) * ln(dispersion) + i * ln((dispersion - 1) / dispersion) END AS lg
   FROM (SELECT *, unnest(generate_series(n, n + 400)) AS i FROM rp WHERE n > 0)),
 sp AS (SELECT rp.*, CASE WHEN rp.n = 0 THEN 0.0 ELSE -log10(least(1, tail)) END AS surprise FROM rp LEFT JOIN (SELECT slot, sum(exp(lg)) AS tail FROM tp GROUP BY 1) USING (slot)),
 sv AS (SELECT *, CASE WHEN surprise < 2 THEN NULL WHEN n >= greatest(3, 3 * mean) AND pow(10, surprise) >= 17520 THEN 'critical' WHEN n >= greatest(3, 3 * mean) AND pow(10, surprise) >= 4380 THEN 'high' WHEN n >= greatest(3, 3 * mean) AND pow(10, surprise) >= 1460 THEN 'elevated' ELSE 'watch' END AS severity FROM sp)"""


def takeoff_rows(spark, sf_dir):
    """Takeoffs of each slot; a slot is live if it has a view."""
    n = detectors.takeoff_slots(A.slot_counts(spark, sf_dir), A.takeoffs(spark, sf_dir)).select("slot", "n")
    return n.join(live_slots(spark, sf_dir).select("slot", "live"), "slot").select(F.lit("all").alias("cohort"), "slot", "n", F.coalesce("live", F.lit(False)).alias("live"))


@query("backtest_takeoffs", with_("e s o tk", WALK + TAILS + " SELECT cohort, slot, n, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, tier, samples, days, round(surprise, 6) AS surprise, severity FROM sv"))
def backtest_takeoffs(spark, sf_dir):
    """Each live slot against the 28 days before it."""
    out = backtest.replayed(takeoff_rows(spark, sf_dir))
    return out.select("cohort", "slot", "n", r6("mean").alias("mean"), r6("dispersion").alias("dispersion"), "tier", "samples", "days", r6("surprise").alias("surprise"), "severity")


#: Views of all users, ten to one, so that the small tables have counts worth an alarm; factors of the injections.
FACTORS = (1, 3, 10)
LEVEL_ROWS = with_("e s", f"+ q AS (SELECT CAST(CAST(f AS DOUBLE) AS VARCHAR) AS series, slot, CASE WHEN slot > (SELECT max(slot) FROM s) - 7200 THEN floor(10 * n * f + 0.5) ELSE 10.0 * n END AS n FROM s, unnest([{', '.join(map(str, FACTORS))}]) u(f))")
LEVELS = f"""WITH RECURSIVE ex AS ({expectation_sql(LEVEL_ROWS, False, 15)}),
 lz AS (SELECT *, CASE WHEN ready THEN (n - expected) / std ELSE 0 END AS z, row_number() OVER (PARTITION BY series, ready ORDER BY slot) AS k FROM ex),
 cs AS (SELECT series, k, slot, n, expected, z, greatest(0, least(8.0, greatest(-4.0, z)) - 1.5) AS s FROM lz WHERE ready AND k = 1
  UNION ALL SELECT lz.series, lz.k, lz.slot, lz.n, lz.expected, lz.z, greatest(0, cs.s + least(8.0, greatest(-4.0, lz.z)) - 1.5) FROM cs JOIN lz ON lz.series = cs.series AND lz.ready AND lz.k = cs.k + 1),
 lv AS (SELECT series, slot, n, expected, z, CAST(CASE WHEN z >= 7 THEN 5 ELSE least(4, floor(4 * greatest(z, 0) / 7) + 1) END AS BIGINT) AS level, s, k FROM cs)"""


def level_slots(spark, sf_dir):
    return A.slot_counts(spark, sf_dir).select("slot", (F.col("n") * 10).alias("n"))


@query("backtest_levels", LEVELS + " SELECT series, slot, n, round(expected, 4) AS expected, round(z, 4) AS z, level, round(s, 4) AS s FROM lv")
def backtest_levels(spark, sf_dir):
    """Slots that their own past expects, with the cumulative sum, as they were and with injections."""
    out = backtest.levels(backtest.injections(level_slots(spark, sf_dir), list(FACTORS)), "series").filter("ready")
    return out.select("series", "slot", "n", F.round("expected", 4).alias("expected"), F.round("z", 4).alias("z"), "level", F.round("s", 4).alias("s"))


CROSSED = """, rc AS (SELECT series, k, slot, s, CASE WHEN s >= 20 THEN 2 WHEN s >= 12 THEN 1 ELSE 0 END AS fired, 0 AS was FROM lv WHERE k = 1
  UNION ALL SELECT lv.series, lv.k, lv.slot, lv.s, greatest(CASE WHEN lv.s < 6 THEN 0 ELSE rc.fired END, CASE WHEN lv.s >= 20 THEN 2 WHEN lv.s >= 12 THEN 1 ELSE 0 END), CASE WHEN lv.s < 6 THEN 0 ELSE rc.fired END FROM rc JOIN lv ON lv.series = rc.series AND lv.k = rc.k + 1),
 xs AS (SELECT series, slot, CASE fired WHEN 2 THEN 'critical' ELSE 'high' END AS severity FROM rc WHERE fired > was)"""


@query("backtest_crossings", LEVELS + CROSSED + " SELECT series, slot // 2592000 AS month, severity, count(*) AS n FROM xs GROUP BY 1, 2, 3")
def backtest_crossings(spark, sf_dir):
    """Crossings of the cumulative sum in months of 30 days."""
    x = backtest.crossings(backtest.levels(backtest.injections(level_slots(spark, sf_dir), list(FACTORS)), "series"))
    return x.groupBy("series", F.floor(F.col("slot") / 2592000).alias("month"), "severity").agg(F.count("*").alias("n"))


ALARMS = """, ar AS (SELECT CAST(series AS DOUBLE) AS factor, CAST(min(mins) FILTER (level >= 4 OR s >= 12) AS BIGINT) AS high, CAST(min(mins) FILTER (level >= 5 OR s >= 20) AS BIGINT) AS critical
  FROM (SELECT *, (slot - max(slot) OVER () + 7200) / 60 AS mins FROM lv) WHERE mins > 0 GROUP BY 1)"""


@query("backtest_injections", LEVELS + ALARMS + " SELECT * FROM ar")
def backtest_injections(spark, sf_dir):
    """Minutes until an injection is found."""
    return backtest.time_to_alarm(level_slots(spark, sf_dir), list(FACTORS))


@query("backtest_bounds", LEVELS.replace("WITH RECURSIVE ex", "WITH RECURSIVE " + with_("e s o tk", WALK + TAILS).removeprefix("WITH ") + ", ex", 1) + ALARMS + CROSSED + """,
 dp AS (SELECT slot // 86400 AS day, max(level) AS peak, count(*) AS k FROM lv WHERE series = '1.0' GROUP BY 1),
 v AS (SELECT unnest([{'bound': 'minutes to high', 'value': (SELECT CAST(high AS DOUBLE) FROM ar WHERE factor = 3), 'most': 60.0}, {'bound': 'minutes to critical', 'value': (SELECT CAST(critical AS DOUBLE) FROM ar WHERE factor = 3), 'most': 120.0},
  {'bound': 'takeoff criticals', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM sv WHERE severity = 'critical'), 'most': 0.0},
  {'bound': 'takeoff public alerts', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM sv WHERE severity <> 'watch'), 'most': (SELECT ceil(count(DISTINCT slot // 86400) * 12 / 365.0) + 2 FROM sv)},
  {'bound': 'share of 1-in-100 scores', 'value': (SELECT coalesce(avg(CASE WHEN surprise >= 2 THEN 1.0 ELSE 0 END), 0) FROM sv), 'most': 0.02}, {'bound': 'warm slots', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM sv), 'most': 336.0},
  {'bound': 'crossings', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM xs WHERE series = '1.0'), 'most': (SELECT ceil(coalesce(sum(k), 0) / 48.0 / 20) FROM dp)}, {'bound': 'critical crossings', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM xs WHERE series = '1.0' AND severity = 'critical'), 'most': (SELECT ceil(coalesce(sum(k), 0) / 48.0 / 60) FROM dp)},
  {'bound': 'level 5 days', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM dp WHERE peak >= 5), 'most': (SELECT ceil(greatest(count(*), 1) / 30.0) FROM dp)}, {'bound': 'level 4 days', 'value': (SELECT CAST(count(*) AS DOUBLE) FROM dp WHERE peak >= 4), 'most': (SELECT ceil(greatest(count(*), 1) / 15.0) FROM dp)}]) AS b)
 SELECT b.bound AS bound, round(b.value, 6) AS value, CAST(b.most AS DOUBLE) AS most, coalesce(CASE WHEN b.bound = 'warm slots' THEN b.value >= b.most ELSE b.value <= b.most END, false) AS ok FROM v""")
def backtest_bounds(spark, sf_dir):
    """What the detectors promise, as this history has it."""
    s = level_slots(spark, sf_dir)
    out = backtest.bounds(backtest.replayed(takeoff_rows(spark, sf_dir)), backtest.levels(s), backtest.time_to_alarm(s, list(FACTORS)))
    return out.withColumn("value", r6("value"))
