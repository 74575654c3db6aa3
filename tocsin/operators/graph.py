"""Closures and components by joins that repeat until nothing changes; each round is checkpointed, so lost executors cost no replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, tight_cell
from ..session import shared_dir
from .joins import radius_pairs


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component (the smallest id it reaches) of the edges (a, b), and of nodes (id) without any."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    if nodes is not None:
        labels = nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    labels = kept(labels)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = kept(step.join(jump, "component", "left").select("id", "was", F.least("component", "further").alias("component")))
        if new.filter("component < was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """node, ancestor, depth (the shortest) over all paths; new pairs are joined on until there are none."""
    e = kept(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node is not null and ancestor is not null and node <> ancestor").distinct())
    all_pairs = kept(e.withColumn("depth", F.lit(1).cast("long")))
    front = all_pairs
    while True:
        up = e.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        step = front.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")).filter("node <> ancestor")
        front = kept(step.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")).join(all_pairs.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if front.isEmpty():
            return all_pairs
        all_pairs = kept(all_pairs.unionByName(front))


def heads(nodes: DataFrame, edges: DataFrame, node: str, predecessor: str) -> DataFrame:
    """nodes that are nobody's predecessor."""
    return nodes.join(edges.select(F.col(predecessor).alias(node)), node, "left_anti")


def radius_components(points: DataFrame, key: str, km: float, keys: list[str] | None = None) -> DataFrame:
    """keys, key, component (its smallest key) of points linked when no farther apart than km, of equal keys.

    Points of one `tight_cell` are linked in any case, so that only cells are nodes. Places of different cells are compared, but what comes
    of that is one row for two cells. Points without a place stand alone."""
    keys = keys or []
    row, col = tight_cell("lat", "lon", km)
    p = points.filter(has_place()).select(*keys, key, "lat", "lon", row.alias("_row"), col.alias("_col"))
    at = [*keys, "_row", "_col"]
    node = F.struct(*keys, "least") if keys else F.col("least")
    cells = kept(p.groupBy(*at).agg(F.min(key).alias("least")).withColumn("id", node))
    places = p.select(*at, "lat", "lon").distinct().join(cells, at).select(*keys, "id", "lat", "lon")
    named = components(radius_pairs(places, "id", km, keys=keys).select("a", "b").distinct(), cells.select("id"))
    least = F.col("component.least") if keys else F.col("component")
    of_cells = cells.join(named, "id").select(*at, least.alias("component"))
    alone = points.filter(~has_place()).select(*keys, key, F.col(key).alias("component"))
    return p.join(of_cells, at).select(*keys, key, "component").unionByName(alone)


def has_place() -> Column:
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return known("lat") & known("lon")


def places_of(points: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Points at one place (lat, lon) as one: key and `place` (the place's smallest key) of all points, and place, lat, lon, n. A point without
    a place has its own."""
    own = F.when(~has_place(), F.col(key))
    p = points.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), own.alias("_own"))
    places = kept(p.groupBy("_lat", "_lon", "_own").agg(F.min(key).alias("place"), F.count("*").alias("n")))
    q = places.select(*[F.col(c).alias(f"{c}2") for c in ("_lat", "_lon", "_own")], "place")
    same = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in ("_lat", "_lon", "_own")]
    return p.join(q, same).select(key, "place"), places.select("place", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "n")


def dbscan(points: DataFrame, key: str, km: float, least: int) -> DataFrame:
    """key, role (core, border, noise), cluster (its smallest core; null for noise). A point counts itself; a border point in reach
    of several clusters goes to the lowest. Points at one place share their fate and are one with its number of them."""
    members, places = places_of(points, key)
    pairs = kept(radius_pairs(places, "place", km).select("a", "b"))
    both = pairs.union(pairs.select("b", "a"))
    n = both.join(places.select(F.col("place").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    near = places.select(F.col("place").alias("id"), "n").join(n, "id", "left").select("id", (F.coalesce("others", F.lit(0)) + F.col("n") >= least).alias("core"))
    near = kept(near)
    cores = near.filter("core").select("id")
    inner = pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    clusters = components(inner, cores)
    border = both.join(clusters.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
    out = near.join(clusters, "id", "left").join(border, "id", "left")
    role = F.when(F.col("core"), "core").when(F.col("near").isNotNull(), "border").otherwise("noise")
    out = out.select(F.col("id").alias("place"), role.alias("role"), F.coalesce("component", "near").alias("cluster"))
    return members.join(out, "place").select(key, "role", "cluster")


def grid_components(cells: DataFrame, row: str, col: str) -> DataFrame:
    """row, col, component of cells that touch each other, at corners too; a component is named by its least cell."""
    c = cells.select(F.struct(F.col(row).alias("r"), F.col(col).alias("c")).alias("id")).distinct()
    around = F.explode(F.array(*[F.struct((F.col("id.r") + i).alias("r"), (F.col("id.c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]))
    edges = c.select(F.col("id").alias("a"), around.alias("b")).join(c.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    return components(edges, c).select(F.col("id.r").alias(row), F.col("id.c").alias(col), F.concat_ws(":", "component.r", "component.c").alias("component"))


def cluster_summary(members: DataFrame, cluster: str, key: str, lat: str, lon: str) -> DataFrame:
    """cluster, n, lat, lon (means) and nearest, the member closest to them."""
    centre = members.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(lat).alias("c_lat"), F.avg(lon).alias("c_lon"))
    d = members.join(centre, cluster).withColumn("_km", haversine(lat, lon, "c_lat", "c_lon"))
    near = d.groupBy(cluster).agg(F.min_by(key, F.struct("_km", key)).alias("nearest"))
    return centre.join(near, cluster).select(cluster, "n", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "nearest")


def greedy(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of those kept when taken by order (id, o: no two alike) and none kept before is a partner (pairs: a, b): those that beat all their
    partners are kept and rule these out, round by round, until all are settled."""
    open_, chosen = kept(order), None
    edges = kept(pairs.union(pairs.select("b", "a")))
    while not open_.isEmpty():
        best = edges.join(open_.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("o").alias("least"))
        now = kept(open_.join(best, "id", "left").filter(F.col("least").isNull() | (F.col("o") < F.col("least"))).select("id"))
        chosen = now if chosen is None else kept(chosen.union(now))
        out = now.union(edges.join(now.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))).distinct()
        open_ = kept(open_.join(out, "id", "left_anti"))
    return order.select("id").limit(0) if chosen is None else chosen


def spread_first(points: DataFrame, key: str, value: str, km: float) -> DataFrame:
    """Points kept when taken by value (down, then key) and none kept before is within km. Of points at one place only the first can be, so
    that the others are left out before any are paired."""
    order = F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))
    members, places = places_of(points, key)
    first = members.join(points.select(key, order.alias("o")), key).groupBy("place").agg(F.min("o").alias("o"))
    first = kept(first.join(places, "place").select(F.col("o.k").alias("id"), "o", "lat", "lon"))
    chosen = greedy(first.select("id", "o"), kept(radius_pairs(first, "id", km).select("a", "b")))
    return points.join(chosen.withColumnRenamed("id", key), key, "left_semi")


def strongest_associations(closure: DataFrame, links: DataFrame) -> DataFrame:
    """node, topic, primary: what a node and its ancestors (closure: node, ancestor) are linked with (links: node, topic, primary), and
    whether any of these links is a primary one."""
    own = links.select("node", "topic", "primary")
    of = closure.join(own.withColumnRenamed("node", "ancestor"), "ancestor").select("node", "topic", "primary")
    return own.unionByName(of).groupBy("node", "topic").agg(F.bool_or("primary").alias("primary"))
