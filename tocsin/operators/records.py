"""Keyed records: provenance, pruning, membership, conflicts, references, holes, summaries of deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .sequences import islands
from .tables import last_n


def provenance_upsert(target: DataFrame, new: DataFrame, key: str = "slot") -> DataFrame:
    """Slots (key, source, total, live) after a batch: a live row is never turned into a backfilled one, totals never fall, and what the
    new row leaves out stays."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in ("source", "total", "live")])
    both = target.join(n, key, "full_outer")
    keep = F.col("live") & ~F.coalesce("_live", F.lit(False))
    return both.select(
        key, F.when(keep, F.col("source")).otherwise(F.coalesce("_source", "source")).alias("source"), F.greatest("total", "_total").alias("total"),
        (F.coalesce("live", F.lit(False)) | F.coalesce("_live", F.lit(False))).alias("live"),
    )


def pruned(rows: DataFrame, key: str, time: str, before: int, *references: DataFrame) -> DataFrame:
    """rows without those that are older and that no reference table (key) names."""
    old = rows.filter(F.col(time) < before).select(key)
    for r in references:
        old = old.join(r.select(key), key, "left_anti")
    return rows.join(old, key, "left_anti")


def membership(previous: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """key, active, change (entered, left, stayed) of the last snapshot's members and those before."""
    a, b = previous.select(key, F.lit(True).alias("was")), snapshot.select(key, F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "entered").when(F.col("now").isNull(), "left").otherwise("stayed")
    return a.join(b, key, "full_outer").select(key, F.col("now").isNotNull().alias("active"), change.alias("change"))


def first_with_conflicts(rows: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """key, first (signature of the first row), n, conflicts (rows with another one)."""
    first = rows.groupBy(key).agg(F.min_by(signature, F.struct(*order)).alias("first"))
    return rows.join(first, key).groupBy(key, "first").agg(F.count("*").alias("n"), F.count_if(~F.col(signature).eqNullSafe(F.col("first"))).alias("conflicts"))


def budget_split(rows: DataFrame, charge: str, status: str, statuses: list[str]) -> DataFrame:
    """The charge spent in each status, and in all."""
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col(status) == s, F.col(charge))), F.lit(0)).alias(s) for s in statuses], F.coalesce(F.sum(charge), F.lit(0)).alias("total"))


def delta_summary(deltas: DataFrame, cell: str, delta: str = "delta") -> DataFrame:
    """cells, positive, negative, net and the cell of the largest delta (the least cell on ties)."""
    d = F.col(delta)
    return deltas.agg(
        F.count("*").alias("cells"), F.sum(F.when(d > 0, d).otherwise(0)).alias("positive"), F.sum(F.when(d < 0, d).otherwise(0)).alias("negative"), F.sum(d).alias("net"),
        F.min(F.struct((-d).alias("d"), F.col(cell).alias("c")))["c"].alias("top_cell"),
    )


#: Shares of the excess from which a cluster, a neighbourhood and a cell make an anchor, and the first two a region.
ANCHOR, REGION = (0.26, 0.30, 0.18), (0.14, 0.16)


def pattern_label(up_end: Column, down_end: Column, up_near: Column, down_near: Column, up_cell: Column, down_cell: Column) -> Column:
    """How concentrated an excess is, from the shares that its best endpoint cluster, 3 by 3 neighbourhood and cell have in departures (up)
    and arrivals (down)."""
    end, near, cell = ANCHOR
    label = F.when((up_end >= end) | (up_near >= near) | (up_cell >= cell), "specific departure anchor")
    label = label.when((down_end >= end) | (down_near >= near) | (down_cell >= cell), "specific arrival anchor")
    label = label.when((up_end >= REGION[0]) | ((up_near >= REGION[1]) & (up_near >= down_near)), "regional departure concentration")
    return label.when((down_end >= REGION[0]) | (down_near >= REGION[1]), "regional arrival concentration").otherwise("diffuse national redistribution")


def concentration(deltas: DataFrame, row: str, col: str, delta: str = "delta") -> DataFrame:
    """One row: positive (the sum of positive deltas), cell_share and near_share, what the best cell and the best 3 by 3 neighbourhood of
    positive cells have of it; 0 where nothing is positive."""
    up = deltas.filter(F.col(delta) > 0)
    one = up.agg(F.coalesce(F.sum(delta), F.lit(0)).alias("positive"), F.max(delta).alias("_cell"))
    best = neighbourhoods(up, row, col, delta).agg(F.max("total").alias("_near"))
    share = lambda c: F.coalesce(F.when(F.col("positive") > 0, F.col(c) / F.col("positive")), F.lit(0.0))
    return one.crossJoin(F.broadcast(best)).select("positive", share("_cell").alias("cell_share"), share("_near").alias("near_share"))


def cluster_diameters(members: DataFrame, cluster: str, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """cluster, km: the largest distance of two members. Meant for clusters that were thinned out before (spread_first)."""
    a = members.select(cluster, F.col(key).alias("a"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"))
    b = members.select(cluster, F.col(key).alias("b"), F.col(lat).alias("lat_b"), F.col(lon).alias("lon_b"))
    far = a.join(b, cluster).filter("a < b").groupBy(cluster).agg(F.max(haversine("lat_a", "lon_a", "lat_b", "lon_b")).alias("km"))
    return members.select(cluster).distinct().join(far, cluster, "left").select(cluster, F.coalesce("km", F.lit(0.0)).alias("km"))


def shared_member_matches(a: DataFrame, b: DataFrame, key_a: str, key_b: str, members: str) -> DataFrame:
    """key_a, key_b of rows whose member arrays overlap: an equi join on members, no pairwise test."""
    x = a.select(key_a, F.explode(members).alias("_m"))
    y = b.select(key_b, F.explode(members).alias("_m"))
    return x.join(y, "_m").select(key_a, key_b).distinct()


def resolved_references(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """source_id, ref, external_id: what references (source_id, ref) mean by an evidence's external id or its message id."""
    one = references.join(evidence.select("source_id", F.col("external_id").alias("ref"), "external_id"), ["source_id", "ref"])
    other = references.join(evidence.select("source_id", F.col("message_id").alias("ref"), "external_id"), ["source_id", "ref"])
    return one.unionByName(other).distinct()


def context_candidates(focus: DataFrame, rows: DataFrame, n: int = 12, within: int = 3 * 86400) -> DataFrame:
    """focus_id, id, place: for each focus (focus_id, source, region, topics, t) the newest rows (id, the same) of other sources and the same
    region with a topic in common, not long before."""
    f = focus.select("focus_id", F.col("source").alias("own"), "region", F.col("t").alias("t0"), F.explode("topics").alias("topic"))
    r = rows.select("id", "source", "region", "t", F.explode("topics").alias("topic"))
    near = f.join(r, ["region", "topic"]).filter((F.col("source") != F.col("own")) & F.col("t").between(F.col("t0") - within, F.col("t0"))).select("focus_id", "id", "t").distinct()
    return last_n(near, "focus_id", [F.desc("t"), F.asc("id")], n, "place")


def due_sources(sources: DataFrame, now: int) -> DataFrame:
    """Sources (id, period, checked, retry_after) whose poll bucket has changed and whose pause is over."""
    bucket = lambda t: F.floor(t / F.col("period"))
    return sources.filter(F.col("checked").isNull() | (bucket(F.lit(now)) > bucket(F.col("checked")))).filter(F.col("retry_after").isNull() | (F.col("retry_after") <= now))


def live_days(slots: DataFrame, events: DataFrame, least: int, time: str = "t") -> DataFrame:
    """slots with live: whether their day has so many events."""
    days = events.groupBy(F.floor(F.col(time) / 86400).alias("_day")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("_day", F.lit(True).alias("live"))
    return slots.withColumn("_day", F.floor(F.col("slot") / 86400)).join(days, "_day", "left").select("slot", F.coalesce("live", F.lit(False)).alias("live"))


def hole_ranges(missing: DataFrame, step: int, time: str = "slot") -> DataFrame:
    """start, end, n of runs of missing steps. Runs are found within days and joined across midnight, so no task has all of them."""
    day = missing.withColumn("_day", F.floor(F.col(time) / 86400))
    w = Window.partitionBy("_day").orderBy(time)
    runs = islands(day, "_day", time, F.col(time) - F.lag(time).over(w) > step).groupBy("_day", "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    w = Window.orderBy("start")  # one row for each run and day: a handful
    runs = runs.withColumn("_new", F.coalesce((F.col("start") - F.lag("end").over(w) > step).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_run")


def neighbourhoods(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """cells (as 'r:c' in order), total, n: the 3 by 3 surroundings of each cell with the cells that are there, each set of cells once."""
    near = cells.select(row, col, value, F.explode(F.array(*[F.struct((F.col(row) + i).alias("r"), (F.col(col) + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("at"))
    centre = cells.select(F.struct(F.col(row).alias("r"), F.col(col).alias("c")).alias("at"))
    each = near.join(centre, "at").groupBy("at").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.col(row).cast("string"), F.col(col).cast("string")))).alias("cells"), F.sum(value).alias("total"), F.count("*").alias("n"))
    return each.select("cells", "total", "n").distinct()
