"""Groups of aircraft: keys that last, footprints that don't grow, hours that must be covered, odd tables."""

import random

from pyspark.sql import functions as F

from tocsin.operators import graph
from tocsin.operators.graph import components
from tocsin.operators.joins import radius_pairs
from tocsin.plans import behaviour as B

HOUR, DAY = 3600, 86400
NOW = 40 * DAY


def frame(spark, rows):
    return spark.createDataFrame(rows, "hex string, t long, lat double, lon double")


def instants(spark, *at):
    return spark.createDataFrame([(x,) for x in at], "instant long")


def hours(spark, skip=()):
    return spark.createDataFrame([(h,) for h in range(17 * 24, 41 * 24) if h not in skip], "hour long")


def test_an_episode_keeps_its_key_by_its_members(spark):
    rows = [(NOW + 600, 3, ["b", "c"]), (NOW + 600, 3, ["x", "y"]), (NOW + 1200, 4, ["a", "c", "d"]), (NOW + 1800, 3, ["z"]), (NOW + 1800, 3, ["d"]), (NOW + HOUR, 3, ["a", "c"])]
    out = B.episodes(spark.createDataFrame(rows, "instant long, level int, hexes array<string>"))
    got = {(r["instant"] - NOW, r["hexes"][0]): r["event_key"].split(":")[1] for r in out.collect()}
    # the middle cluster takes b's event and its members become that event's; so z is new at last, d is still of it; the next hour begins anew
    assert got == {(600, "b"): "b", (600, "x"): "x", (1200, "a"): "b", (1800, "z"): "z", (1800, "d"): "b", (HOUR, "a"): "a"}


def test_footprints_do_not_chain_outward(spark):
    now = [(f"n{k}", NOW - 600 - k, 50.0 + 0.3 * k, 8.0) for k in range(6)]  # a chain: neighbours 33 km apart
    past = [(f"p{d}", NOW - d * DAY - 60, 50.0, 8.3) for d in range(1, 15)]
    beyond = [(f"q{d}{k}", NOW - d * DAY - 90 - k, 49.2 - 0.01 * k, 8.0) for d in range(1, 15) for k in range(9)]  # 89 km and more from any member
    out = B.origin_clusters(frame(spark, now + past + beyond), instants(spark, NOW), hours(spark)).collect()
    assert [(r["n"], r["median"], r["days"], r["level"]) for r in out] == [(6, 1.0, 21, 3)]
    assert out[0]["hexes"] == [f"n{k}" for k in range(6)] and out[0]["event_key"].endswith(":n0")
    near = [(h, t, lat + 0.4, lon) for h, t, lat, lon in beyond]
    assert B.origin_clusters(frame(spark, now + past + near), instants(spark, NOW), hours(spark)).collect() == []


def test_hours_must_be_covered(spark):
    at = NOW + 1800  # two halves of two hours
    turns = [(f"n{k}", at - 100, 50.0, 8.0 + k) for k in range(6)] + [("far", at - 100, -20.0, 8.0)]
    past = [(f"p{d}", at - d * DAY - 60, 10.0, 8.0) for d in range(1, 22)]
    got = B.turn_clusters(frame(spark, turns + past), instants(spark, at), hours(spark)).collect()
    assert [(r["n"], r["median"], r["days"], r["level"]) for r in got] == [(6, 0.5, 21, 4)]
    gone = {(at - d * DAY) // HOUR for d in range(1, 13)}
    assert B.turn_clusters(frame(spark, turns + past), instants(spark, at), hours(spark, gone)).collect() == []  # nine days are too few
    assert B.turn_clusters(frame(spark, turns + turns), instants(spark, at), hours(spark)).collect()[0]["n"] == 6  # repeated rows, no past


def test_nothing_comes_of_nothing(spark):
    none = frame(spark, [])
    assert B.origin_clusters(none, instants(spark, NOW), hours(spark)).collect() == []
    assert B.turn_clusters(none, instants(spark, NOW), hours(spark)).collect() == []


def test_members_are_held_against_the_places_around_them_only(spark, monkeypatch):
    now = [(f"n{k:03}", NOW - 600 - k % 60, 50.0 + 0.001 * (k % 5), 8.0) for k in range(300)]
    past = [(f"p{d}{k}", NOW - d * DAY - 60, lat, 8.0) for d in range(1, 15) for k, lat in enumerate([50.0] * 30 + [50.5] * 20 + [50.6] * 50)]  # 0, 55 and 66 km away
    seen = []
    monkeypatch.setattr(graph, "components", lambda edges, nodes: seen.append(edges.count()) or components(edges, nodes))
    out = B.origin_clusters(frame(spark, now + past), instants(spark, NOW), hours(spark)).collect()
    assert [(r["n"], r["median"], r["days"]) for r in out] == [(300, 50.0, 21)]
    assert [x for x in seen if isinstance(x, int)] == [0]  # one cell, no pairs at all


def test_groups_of_copies_link_as_pairs_would(spark):
    rng = random.Random(4)
    spots = [(rng.uniform(59, 62), rng.uniform(-180, 180)) for _ in range(60)] + [(0.0, 179.9), (0.0, -179.9), (89.9, 0.0), (89.9, 170.0), (None, 1.0), (None, 1.0)]
    rows = [(g, f"{k:03}{g}", *spots[k % len(spots)]) for g in (1, 2) for k in range(130)]
    p = spark.createDataFrame(rows, "g int, k string, lat double, lon double")
    got = {(r["g"], r["k"]): r["component"] for r in graph.radius_components(p, "k", 150.0, ["g"]).collect()}
    plain = components(radius_pairs(p, "k", 150.0, keys=["g"]).select("a", "b"), p.select(F.col("k").alias("id"))).collect()
    assert len(got) == 260 and {k: c for (_, k), c in got.items()} == {r["id"]: r["component"] for r in plain}


def test_turns_of_one_cell_make_no_pairs(spark, monkeypatch):
    at = NOW + 1800
    turns = [(f"n{k:03}", at - 100, 50.0 + 0.001 * (k % 5), 8.0) for k in range(300)]
    past = [(f"p{d}", at - d * DAY - 60, 10.0, 8.0) for d in range(1, 22)]
    seen = []
    monkeypatch.setattr(graph, "components", lambda edges, nodes: seen.append(edges.count()) or components(edges, nodes))
    out = B.turn_clusters(frame(spark, turns + past), instants(spark, at), hours(spark)).collect()
    assert [(r["n"], r["median"], r["level"]) for r in out] == [(300, 0.5, 4)] and seen == [0]


def test_stations_at_repeated_places_link_as_their_places(spark, monkeypatch):
    rows = [(k, float((k % 40 * 37) % 140 - 70), float((k % 40 * 73) % 340 - 170)) for k in range(1200)]
    p, seen = spark.createDataFrame(rows, "k long, lat double, lon double"), []
    monkeypatch.setattr(graph, "components", lambda edges, nodes: seen.append((edges.count(), nodes.count())) or components(edges, nodes))
    got = {r["k"]: r["component"] for r in graph.radius_components(p, "k", 1600.0).collect()}
    plain = components(radius_pairs(p.filter("k < 40"), "k", 1600.0).select("a", "b"), p.filter("k < 40").select(F.col("k").alias("id"))).collect()
    least = {r["id"]: r["component"] for r in plain}
    assert len(got) == 1200 and got == {k: least[k % 40] for k in got} and len(set(least.values())) > 1
    assert len(seen) == 1 and seen[0][0] < 40 * 40 / 2 and seen[0][1] <= 40  # thirty stations a place, linked once
