"""The weekly baseline over orders: years squeezed into months of half hours, with an outage that parts them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.timeutil import HALF_HOUR, unix
from ..plans import weekly
from . import query, r6
from .records import holiday_oracle

#: Ten days of orders are one here; the series breaks off for five days at a moment of 1972.
SQUEEZE, BREAK, OUTAGE = 10, 88_000_000, 5 * 86400


def series(spark, sf_dir):
    """cohort, slot, n."""
    o = A.table(spark, sf_dir, "orders")
    t = F.floor(unix("o_orderdate") / SQUEEZE) + F.col("o_custkey") % 3 * HALF_HOUR
    t = F.when(t >= BREAK, t + OUTAGE).otherwise(t)
    return o.groupBy(F.col("o_orderpriority").alias("cohort"), (t - t % HALF_HOUR).alias("slot")).agg(F.count("*").alias("n"))


def sql(skip: bool) -> str:
    days = holiday_oracle(1970, 2100) + ", " if skip else ""
    near = "EXISTS (SELECT 1 FROM hd WHERE date_diff('day', hday, CAST(make_timestamp(slot * 1000000) AS DATE)) BETWEEN -2 AND CASE WHEN holiday IN ('new_year', 'thanksgiving') THEN 3 ELSE 2 END)" if skip else "false"
    return f"""WITH {days}r0 AS (SELECT o_orderpriority AS cohort, CAST(epoch(o_orderdate) AS BIGINT) // {SQUEEZE} + o_custkey % 3 * 1800 AS t FROM orders), r1 AS (SELECT cohort, CASE WHEN t >= {BREAK} THEN t + {OUTAGE} ELSE t END AS t FROM r0),
 sr AS (SELECT cohort, t // 1800 * 1800 AS slot, count(*) AS n FROM r1 GROUP BY 1, 2), gp AS (SELECT *, slot - lag(slot) OVER (PARTITION BY cohort ORDER BY slot) AS step FROM sr), md AS (SELECT cohort, median(step) AS u FROM gp GROUP BY 1),
 cu AS (SELECT cohort, slot, n, count(*) FILTER (step > greatest(86400, 2 * u)) OVER (PARTITION BY cohort ORDER BY slot) AS part FROM gp JOIN md USING (cohort)), ct AS (SELECT cohort, part, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, max(slot) DESC) AS k FROM cu GROUP BY 1, 2),
 de AS (SELECT cu.*, {near} AS off FROM cu JOIN ct USING (cohort, part) WHERE k = 1), hs AS (SELECT cohort, slot % 604800 // 1800 AS w, CAST(n AS DOUBLE) AS x FROM de WHERE NOT off OR cohort NOT IN (SELECT cohort FROM de WHERE NOT off)),
 ws AS (SELECT cohort, w, count(*) AS samples, median(x) AS med FROM hs GROUP BY 1, 2), wd AS (SELECT cohort, w, 1.4826 * median(abs(x - med)) AS mad FROM hs JOIN ws USING (cohort, w) GROUP BY 1, 2), al AS (SELECT cohort, count(*) AS c, median(x) AS m FROM hs GROUP BY 1),
 j AS (SELECT sr.cohort, slot, CAST(n AS DOUBLE) AS actual, coalesce(med, m) AS usual, coalesce(samples, 0) AS samples, c >= 336 AND samples IS NOT NULL AS ready, med, mad FROM sr LEFT JOIN ws ON ws.cohort = sr.cohort AND ws.w = slot % 604800 // 1800 LEFT JOIN wd ON wd.cohort = sr.cohort AND wd.w = ws.w JOIN al ON al.cohort = sr.cohort)
 SELECT cohort, slot, actual, usual, samples, ready, CASE WHEN ready THEN med ELSE actual END AS expected, round(CASE WHEN ready THEN mad ELSE 0 END, 6) AS std, CASE WHEN ready THEN actual - med ELSE 0 END AS divergence FROM j"""


@query("weekly_expectation", sql(False))
def weekly_expectation(spark, sf_dir):
    return weekly.weekly_expectation(series(spark, sf_dir)).withColumn("std", r6("std"))


@query("weekly_holiday_expectation", sql(True))
def weekly_holiday_expectation(spark, sf_dir):
    return weekly.weekly_expectation(series(spark, sf_dir), skip_holidays=True).withColumn("std", r6("std"))
