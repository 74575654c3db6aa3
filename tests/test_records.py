"""Records and notices on literal rows."""

from pyspark.sql import functions as F

from tocsin.operators import joins, records
from tocsin.plans import notices
from tocsin.queries import notices as notice_queries


def collect(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_provenance(spark):
    old = spark.createDataFrame([(1, "live", 10, True), (2, "back", 5, False)], "slot long, source string, total long, live boolean")
    new = spark.createDataFrame([(1, "back", 12, False), (2, "live", 4, True), (3, "back", 1, False)], old.schema)
    assert collect(records.provenance_upsert(old, new)) == [(1, "live", 12, True), (2, "live", 5, True), (3, "back", 1, False)]


def test_pruning_and_membership(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9)], "id string, t long")
    refs = spark.createDataFrame([("b",)], "id string")
    assert collect(records.pruned(rows, "id", "t", 5, refs)) == [("b", 1), ("c", 9)]
    assert collect(records.membership(rows, spark.createDataFrame([("a",), ("z",)], "id string"), "id")) == [("a", True, "stayed"), ("b", False, "left"), ("c", False, "left"), ("z", True, "entered")]


def test_conflicts_budget_deltas(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 3, None)], "k string, o long, s string")
    assert collect(records.first_with_conflicts(rows, "k", ["o"], "s")) == [("k", "x", 3, 2)]
    assert collect(records.budget_split(spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "s string, n long"), "n", "s", ["a", "b"])) == [(2, 3, 9)]
    d = spark.createDataFrame([("p", 6), ("q", -2), ("r", 6)], "c string, delta long")
    assert collect(records.delta_summary(d, "c")) == [(3, 12, -2, 10, "p")]


def test_what_a_task_of_resolved_references_sorts_does_not_grow(spark, monkeypatch):
    sf, read, wide = "/root/testdata/sf0.001", [], joins.dealt
    monkeypatch.setattr(joins, "ROWS", 100)
    monkeypatch.setattr(joins, "dealt", lambda *a: read.append(wide(*a)) or read[0])
    notice_queries.resolved_references(spark, sf)
    rows = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "orders"))
    each = read[0].groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
    assert read[0].count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()  # each line has its order
    assert read[0].rdd.getNumPartitions() == -(-rows // 100) and each[0] > rows / 200 and each[1] < 300


def test_matches_references_context(spark):
    a = spark.createDataFrame([("a1", ["x", "y"]), ("a2", ["z"])], "a string, m array<string>")
    b = spark.createDataFrame([("b1", ["y", "x"]), ("b2", [])], "b string, m array<string>")
    assert collect(records.shared_member_matches(a, b, "a", "b", "m")) == [("a1", "b1")]
    e = spark.createDataFrame([("s", "e1", "m1"), ("s", "m1", None)], "source_id string, external_id string, message_id string")
    assert collect(records.resolved_references(spark.createDataFrame([("s", "m1"), ("s", "?")], "source_id string, ref string"), e), "external_id") == [("e1",), ("m1",)]
    f = spark.createDataFrame([("f", "s1", "eu", ["a", "b"], 1000)], "focus_id string, source string, region string, topics array<string>, t long")
    r = spark.createDataFrame([("1", "s2", "eu", ["b"], 900), ("2", "s1", "eu", ["a"], 900), ("3", "s2", "us", ["a"], 900), ("4", "s3", "eu", ["a", "b"], 950)], "id string, source string, region string, topics array<string>, t long")
    assert collect(records.context_candidates(f, r), "id", "place") == [("1", 2), ("4", 1)]


def test_schedules_days_holes(spark):
    s = spark.createDataFrame([("a", 60, 100, None), ("b", 60, 130, None), ("c", 60, None, 500), ("d", 60, None, None)], "id string, period long, checked long, retry_after long")
    assert collect(records.due_sources(s, 150), "id") == [("a",), ("d",)]
    slots = spark.createDataFrame([(0,), (86400,)], "slot long")
    assert collect(records.live_days(slots, spark.createDataFrame([(1,), (2,), (86401,)], "t long"), 2)) == [(0, True), (86400, False)]
    missing = spark.createDataFrame([(t,) for t in (1800, 3600, 84600, 86400, 88200, 200000)], "slot long")
    assert collect(records.hole_ranges(missing, 1800)) == [(1800, 3600, 2), (200000, 200000, 1), (84600, 88200, 3)]


def test_neighbourhoods_and_diameters(spark):
    c = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (9, 9, 4)], "r long, c long, v long")
    assert collect(records.neighbourhoods(c, "r", "c", "v")) == [(["0:0", "0:1"], 3, 2), (["9:9"], 4, 1)]
    m = spark.createDataFrame([("k", 1, 0.0, 0.0), ("k", 2, 0.0, 1.0), ("l", 3, 0.0, 0.0)], "k string, i long, lat double, lon double")
    assert [(k, round(km)) for k, km in collect(records.cluster_diameters(m, "k", "i"))] == [("k", 111), ("l", 0)]


def test_predicates(spark):
    p = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (91.0, 0.0), (None, 1.0)], "lat double, lon double")
    assert [r[0] for r in p.select(notices.valid_point()).collect()] == [True, False, False, False]
    j = spark.createDataFrame([('{"unit": "uSv", "status": "ok"}',), ('{"unit": "uSv", "status": "Test"}',), ('{"unit": "x"}',), ('{"unit": "uSv", "approved": false}',), (None,)], "j string")
    assert [r[0] for r in j.select(notices.usable_reading("j", ["uSv"], ["test"])).collect()] == [True, False, False, False, False]
    s = spark.createDataFrame([('{"sample_minutes": 5, "counts": {"a": 0}}',), ('{"sample_minutes": 5, "counts": {"a": -1}}',), ('{"sample_minutes": 0, "counts": {}}',), ("x",)], "s string")
    assert [r[0] for r in s.select(notices.valid_slot_counts("s")).collect()] == [True, False, False, False]


def test_codes_odds_registrations(spark):
    df = spark.createDataFrame([(["TXC001", "048001", "ZZZ999"], 1 / 12345.0, " n-123 ab ")], "c array<string>, p double, r string")
    r = df.select(notices.code_states("c", {"TX": "TX", "48": "TX", "CA": "CA"}), notices.odds_text("p"), notices.normalized_registration("r"), notices.attributed("r", {"a": "123", "b": "x"})).first()
    assert tuple(r) == (["TX"], "1 in 12,000", "N123AB", ["a"])


def test_aircraft_and_reports(spark):
    f = spark.createDataFrame([("r", "h1", "7700", "none", 1, "B52"), ("r", "h1", "7700", None, 1, "B52"), ("r", "h2", None, "none", 0, None), ("r", "h3", "1200", "lifeguard", 2, "C17")], "region string, hex string, squawk string, emergency string, flags int, type string")
    assert collect(notices.aircraft_summary(f, ["region"], ["B52", "E6"])) == [("r", 3, 2, 1, {"B52": 1})]
    pages = spark.createDataFrame([("Intro\nEvent Number: 12\nFacility: A\nEvent Number: 13\nFacility: B\nUnit: 2\n",)], "b string")
    assert collect(notices.report_blocks(pages, "b", "Event Number:", ["Facility", "Unit"])) == [(12, "A", None), (13, "B", "2")]


def test_drops_trips_restrictions_outbreaks(spark):
    s = spark.createDataFrame([("u1", 0, 100.0), ("u1", 7200, 0.0), ("u2", 0, 40.0), ("u2", 7200, 0.0), ("u3", 7000, 90.0), ("u3", 7200, 0.0)], "unit string, t long, power double")
    assert collect(notices.reactor_drops(s)) == [("u1", 7200, 100.0, 0.0)]
    d = spark.createDataFrame([("a", f"u{i}", 600 * i) for i in range(3)] + [("b", "v", 0), ("b", "v", 5)], "site string, unit string, t long")
    assert collect(notices.many_trips(d, "site")) == [("a", 0, 3)]
    r = spark.createDataFrame([("k", 0.0, 0.1, 5), ("k", 0.0, 0.0, 1), ("far", 50.0, 50.0, 1)], "key string, lat double, lon double, t long")
    g = spark.createDataFrame([(7, 0.0, 0.5)], "site_id long, site_lat double, site_lon double")
    assert collect(notices.first_restrictions(r, g), "key", "t", "site_id") == [("k", 1, 7)]
    n = spark.createDataFrame([("cases of measles reported",), ("measly",)], "t string")
    assert collect(notices.outbreak_notices(n, "t", ["measles", "cholera"]), "agents") == [(["measles"],)]
    e = spark.createDataFrame([("notice", "current", 1000, ["a"]), ("notice", "cancelled", 1000, ["a"]), ("context", "current", 1000, ["a"])], "kind string, status string, t long, topics array<string>")
    assert e.filter(notices.eligible_incident(1000, ["a"])).count() == 1
    q = spark.createDataFrame([("pending", None, 0), ("processing", 100, 1), ("processing", 990, 1), ("pending", None, 5)], "status string, leased_at long, attempts int")
    assert q.filter(notices.deliverable(1000)).count() == 2
    u = spark.createDataFrame([(None, True, False, None), (5, True, True, "x"), (None, False, False, None)], "unsubscribed_at long, email_confirmed boolean, phone_confirmed boolean, push_endpoint string")
    assert u.filter(notices.active_subscriber()).count() == 1 and u.filter(F.lit(True)).count() == 3
