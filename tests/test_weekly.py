"""The weekly baseline: dense stretches, holidays, thin slots and clocks."""

import datetime as dt

from tocsin.plans import weekly as W

HALF, DAY, WEEK = 1800, 86400, 604800


def at(*x):
    return int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp())


def rows(spark, r):
    return spark.createDataFrame(r, "cohort string, slot long, n long")


def got(df):
    return {(r["cohort"], r["slot"]): r for r in df.collect()}


def test_only_the_dense_stretch_is_learnt_from(spark):
    start = at(2024, 2, 25)
    old = [("a", start - 40 * DAY + k * HALF, 1000) for k in range(100)]
    new = [("a", start + k * HALF, 10 + k // 336) for k in range(3 * 336) if k != 5 and k != 341 and k != 677]
    out = got(W.weekly_expectation(rows(spark, old + new + [("b", start, 7), ("b", start + HALF, 9)])))
    r = out["a", start + 336 * HALF]
    assert (r["actual"], r["expected"], r["samples"], r["ready"], round(r["std"], 4)) == (11.0, 11.0, 3, True, 1.4826)
    thin = out["a", start - 40 * DAY + 5 * HALF + (start - 40 * DAY) % WEEK * 0]
    assert thin["actual"] == 1000.0 and thin["divergence"] == (989.0 if thin["ready"] else 0.0)
    few = out["b", start]
    assert (few["ready"], few["expected"], few["usual"], few["std"], few["divergence"]) == (False, 7.0, 7.0, 0.0, 0.0)


def test_slots_without_a_sample_fall_back(spark):
    start = at(2024, 2, 25)
    dense = [("a", start + k * HALF, 10) for k in range(4 * 336) if k % 336 != 7]
    lone = [("a", start - 9 * WEEK + 7 * HALF, 50)]
    r = got(W.weekly_expectation(rows(spark, dense + lone)))["a", lone[0][1]]
    assert (r["samples"], r["ready"], r["usual"], r["expected"], r["divergence"]) == (0, False, 10.0, 50.0, 0.0)


def test_holidays_are_left_out_unless_nothing_else_is_there(spark):
    start = at(2024, 6, 23)
    days = [("a", start + k * HALF, 100 if at(2024, 7, 2) <= start + k * HALF < at(2024, 7, 7) else 10) for k in range(2 * 336)]
    only = [("b", at(2024, 7, 4) + k * HALF, 5) for k in range(20)]
    out = got(W.weekly_expectation(rows(spark, days + only), skip_holidays=True))
    r = out["a", at(2024, 7, 4, 12)]
    assert (r["samples"], r["ready"], r["expected"], r["divergence"]) == (1, True, 10.0, 90.0)
    assert out["b", at(2024, 7, 4)]["usual"] == 5.0
    plain = got(W.weekly_expectation(rows(spark, days)))["a", at(2024, 7, 4, 12)]
    assert (plain["samples"], plain["expected"]) == (2, 55.0)


def test_week_slots_are_those_of_the_zone(spark):
    # the same local hour before and after the change of the clocks
    r = [("a", at(2024, 3, 5, 17), 10), ("a", at(2024, 3, 12, 16), 30)] + [("a", at(2024, 3, 5, 17) + k * DAY // 2, 1) for k in range(1, 14)]
    out = got(W.weekly_expectation(rows(spark, r), zone="America/Los_Angeles"))
    assert out["a", at(2024, 3, 12, 16)]["samples"] == 2 and out["a", at(2024, 3, 12, 16)]["usual"] == 20.0
    assert W.weekly_expectation(rows(spark, []), skip_holidays=True).collect() == []
