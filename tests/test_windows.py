"""Event windows on the local clock and without places; canonical texts of JSON."""

import datetime as dt
import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tocsin.functions.canonical import canonical, canonical_digest, canonical_json, number
from tocsin.functions.geo import haversine
from tocsin.plans import windows as W


def test_controls_keep_the_local_hour(spark):
    w = spark.createDataFrame([("e", dt.datetime(2024, 4, 10, 18), dt.datetime(2024, 4, 10, 20), "America/New_York")], "key string, local_start timestamp_ntz, local_end timestamp_ntz, tz string")
    got = {r["week"]: (r["start"], r["end"] - r["start"]) for r in W.shifted(w).collect()}
    utc = lambda *x: int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp())
    assert got[0] == (utc(2024, 4, 10, 22), 7200)
    assert got[-6] == (utc(2024, 2, 28, 23), 7200)  # winter time: an hour later in UTC
    assert len(got) == 11


def test_calmest_controls_and_standing(spark):
    rows = [("e", 0, 4, 9.0, 9.0), ("e", 4, 4, -1.0, 5.0), ("e", 6, 4, 1.0, 3.0), ("e", 8, 4, 12.0, 12.0), ("e", -4, 4, 0.5, 9.0), ("f", 4, 4, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "key string, week int, samples long, total double, absolute double").withColumn("peak", F.col("total"))
    assert [r["week"] for r in W.controls(s, 3).filter("key = 'e'").orderBy("rank").collect()] == [-4, 6, 4]
    assert [(r["key"], r["place"], r["of"]) for r in W.standing(s).collect()] == [("e", 2, 5)]


def test_scores_labels_and_unknown_places(spark):
    m = lambda x: W.match_score(F.lit(x).cast("double"))
    lab = lambda a, b: W.signal_label(F.lit(a).cast("double"), F.lit(b))
    r = spark.range(1).select(m(50), m(225), m(400), m(None), lab(0.8, 0.2), lab(0.5, 0.15), lab(0.1, 0.3), lab(0.1, 0.1), lab(None, 0.3), lab(None, 0.2), lab(None, 0.1), haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert list(r) == [1.0, 0.5, 0.0, None, "strong match", "regional match", "elsewhere", "weak", "one gateway", "a region of gateways", "no gateway", None]


def test_numbers_as_browsers_print_them():
    cases = {1.0: "1", 0.1: "0.1", 1e21: "1e+21", 1e20: "100000000000000000000", 1.5e300: "1.5e+300", 1e-6: "0.000001", 1.25e-7: "1.25e-7", -0.0: "0", 123456.75: "123456.75", 2**53 + 1: "9007199254740992", -12: "-12", 10**400: "null"}
    assert {k: number(k) for k in cases} == cases


def test_spellings_of_one_value_are_one_text(spark):
    a = '{"b": [1.0, {"z": null, "checkedAt": 5, "a": "\\u00e9\\n\\ud800"}], "10": true, "9": false, "observedAt": "x"}'
    b = '{"9":false,"polled_at":{"q":1},"b":[1,{"a":"é\\n\\ud800","z":null}],"10":true}'
    deep = "[" * 300 + "]" * 300
    df = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "{"), (5, "NaN"), (6, '"x"'), (7, deep), (8, "")], "id int, j string")
    got = {r["id"]: (r["t"], r["d"]) for r in df.select("id", canonical_json("j").alias("t"), canonical_digest("j").alias("d")).collect()}
    assert got[1] == got[2] and got[1][0] == '{"9":false,"10":true,"b":[1,{"a":"é\\n\\ud800","z":null}]}'
    assert got[3] == got[4] == got[5] == got[8] == (None, None) and got[6][0] == '"x"' and got[7][0] == deep
    assert spark.createDataFrame([], "j string").select(canonical_digest("j")).collect() == []


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(alphabet=st.characters(exclude_categories=["Cs"])), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abxyz", max_size=3), c, max_size=3), max_leaves=12)


@given(values)
def test_texts_parse_back_and_are_the_plain_sorted_dump(v):
    assert json.loads(canonical(v)) == v
    assert canonical(v) == json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
