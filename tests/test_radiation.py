"""The radiation detector against the rules told event by event, and on odd tables."""

import random

from tocsin.operators.graph import greedy
from tocsin.plans import radiation as R

HOUR = 3600


def test_budget_is_that_of_a_ledger(spark):
    rng = random.Random(5)
    rows, now = [], 0
    for i in range(150):
        now += rng.choice([0, 0, HOUR, 2 * HOUR, 7 * HOUR, 30 * HOUR])
        rows.append((now, f"k{rng.randrange(12)}" if i % 3 else f"k{i}", rng.choice([1, 3, 3, 4, 5]), -float(i), i, "de"))
    df = spark.createDataFrame(rows, "pass long, event_key string, level int, v double, k long, s string").selectExpr("pass", "event_key", "level", "struct(v, k, s) AS first")
    out = {r["first"]["k"]: r for r in R.budgeted(df).collect()}
    ledger: dict = {}
    for now, key, level, _, i, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        spent = any(t >= now - 6 * HOUR for t in ledger.values())
        quiet = level in (3, 4) and key not in ledger and spent
        assert (out[i]["level"], out[i]["suppressed"]) == ((1, True) if quiet else (level, False)), i
        if level >= 3 and not quiet:
            assert out[i]["public_at"] == ledger.setdefault(key, now)
    assert len(out) == len(rows) and any(r["suppressed"] for r in out.values())


def history(station, source, last, hours=60, rate=0.1, end=100 * HOUR, **over):
    rows = [(source, station, end - (hours - h) * HOUR, rate + h % 3 * 0.002, True) for h in range(hours)]
    return rows + [(source, station, end, last, over.get("normal", True))]


def run(spark, stations, rows, passes=(100 * HOUR,)):
    s = spark.createDataFrame(stations, "source string, station_id long, name string, lat double, lon double")
    r = spark.createDataFrame(rows, "source string, station_id long, t long, value double, normal boolean")
    p = spark.createDataFrame([(x,) for x in passes], "pass long")
    return R.radiation_events(s, r, p, ["t"], ["radnet"]).orderBy("pass", "event_key").collect()


def test_neighbours_must_agree_and_copies_do_not_count(spark):
    place = [("de", 1, "A", 50.0, 8.0), ("de", 2, "B", 50.1, 8.0), ("de", 3, "C", 50.2, 8.0), ("eurdep", 3, "C", 50.2, 8.0), ("de", 4, "D", 50.2, 8.001), ("de", 5, "E", 60.0, 8.0)]
    rows = [r for src, k, *_ in place for r in history(k, src, 1.0 + k / 10)]
    alone, group = sorted(run(spark, place, rows), key=lambda r: r["n"])
    assert (group["n"], group["level"], group["coherent"], group["networks"]) == (3, 3, True, "de")  # copy and colocated instrument are gone
    assert (alone["n"], alone["level"], alone["coherent"]) == (1, 1, False)
    assert run(spark, place[:2], rows)[0]["level"] == 1


def test_sparse_networks_are_asked_for_a_second_hour(spark):
    place = [("radnet", 7, "G", 40.0, -100.0)]
    rows = history(7, "radnet", 0.9) + [("radnet", 7, 101 * HOUR, 1.0, True), ("radnet", 7, 102 * HOUR, 12.0, True)]
    out = run(spark, place, rows, [100 * HOUR, 101 * HOUR, 102 * HOUR])
    assert [(r["level"], r["hours"]) for r in out] == [(3, 1), (4, 2), (5, 3)]
    assert len({r["event_key"] for r in out}) == 1 and {r["public_at"] for r in out} == {100 * HOUR}


def test_stations_without_a_word(spark):
    place = [("de", k, None, 50.0 + k, 8.0) for k in range(5)]
    rows = history(0, "de", 9.0, hours=40) + history(1, "de", 9.0, normal=False) + history(2, "de", 9.0, end=96 * HOUR) + history(3, "de", 0.55) + history(4, "de", 0.59, rate=0.15)
    assert run(spark, place, rows) == []  # warming, defective, silent, too small a rise twice
    assert run(spark, place, []) == [] and run(spark, [], rows) == []


def test_greedy_of_nothing(spark):
    none = spark.createDataFrame([], "id long, o long")
    assert greedy(none, spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_month_of_a_station_is_one_row(spark, monkeypatch):
    end, sizes, kept = 100 * HOUR, [], R.kept
    monkeypatch.setattr(R, "kept", lambda df: sizes.append(df.count()) or kept(df))
    rows = history(1, "de", 2.0) + [("de", 1, end - HOUR // 2, 1.5, True), ("de", 1, end - HOUR, 1.5, False)] + history(2, "de", 2.0, rate=1.0)
    r = spark.createDataFrame(rows, "source string, station_id long, t long, value double, normal boolean")
    got = R.departing_stations(r, spark.createDataFrame([(end,)], "pass long"), ["t"]).collect()
    assert [(x["station_id"], x["value"], round(x["med"], 3), x["hours"], x["since"]) for x in got] == [(1, 2.0, 0.102, 2, end - HOUR // 2)]
    assert max(sizes, default=0) <= 2  # stations at passes, not their readings
