"""Queries over the generic test tables, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions that oracles share; each needs those before it.
PRELUDE = {
    "e": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id, event_type, value, props FROM events",
    "s": "SELECT t - t % 1800 AS slot, count(*) AS n FROM e GROUP BY 1",
    "o": "SELECT user_id AS hex, t, event_id, event_type NOT IN ('signup', 'error') AS airborne, value AS v FROM e",
    "tk": "SELECT * FROM (SELECT *, lag(airborne) OVER w AS was, lag(t) OVER w AS previous FROM o WINDOW w AS (PARTITION BY hex ORDER BY t, event_id)) WHERE airborne AND NOT was",
    "st": "SELECT s_suppkey AS station_id, CAST((s_suppkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((s_suppkey * 73) % 340 - 170 AS DOUBLE) AS lon, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "rd": "SELECT l_suppkey AS station_id, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t, l_extendedprice / l_quantity AS value, l_orderkey, l_linenumber FROM lineitem",
    "al": "SELECT o_orderkey AS event_key, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'elevated' ELSE 'watch' END AS severity, o_custkey % 3 AS cohort, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t, o_orderstatus AS status FROM orders",
}


def with_(names: str, sql: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({PRELUDE[n]})" for n in names.split()) + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")


def alarm_oracle(names: str, q: str, s: str = "s") -> str:
    """Crossings by the alarm's rule taken literally, sample by sample; q ends in the samples (series, slot, tie, z)."""
    return with_(names, q + f""", od AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY slot, tie) AS k FROM q),
 rc AS (WITH RECURSIVE r(series, k, slot, s, fired, was) AS (SELECT DISTINCT series, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0, 0 FROM q
  UNION ALL SELECT series, k, slot, v, greatest(CASE WHEN v < 6 THEN 0 ELSE fired END, CASE WHEN v >= 20 THEN 2 WHEN v >= 12 THEN 1 ELSE 0 END), CASE WHEN v < 6 THEN 0 ELSE fired END
  FROM (SELECT r.series, od.k, od.slot, r.fired, greatest(0.0, r.s + least(8.0, greatest(-4.0, od.z)) - 1.5) AS v FROM r JOIN od ON od.series = r.series AND od.k = r.k + 1)) SELECT * FROM r)
 SELECT series, slot, CASE fired WHEN 2 THEN 'critical' ELSE 'high' END AS severity, {s} AS s FROM rc WHERE fired > was""")


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(x) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)
