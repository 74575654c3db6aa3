"""The binary point source: slices, splits within files, pushed filters, and arrays against a record-by-record reading."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.sources import heatmap


def points(rng, n):
    out = []
    for _ in range(n):
        name = f"{'~' * int(rng.random() < 0.3)}{rng.integers(0, 1 << 24):06x}"
        if rng.random() < 0.2:
            out.append({"hex": name, "squawk": int(rng.integers(0, 8000)), "callsign": ["", "AB1", "KÉ 22  ", "LONGNAME"][rng.integers(4)].encode("latin-1", "replace").decode("ascii", "ignore")})
        else:
            out.append({"hex": name, "type": int(rng.integers(0, 13)), "lat": round(float(rng.uniform(-90, 90)), 5), "lon": round(float(rng.uniform(-180, 180)), 5), "alt_ft": 25 * int(rng.integers(-20, 1800)), "on_ground": bool(rng.random() < 0.2), "gs_kt": None if rng.random() < 0.2 else float(rng.integers(0, 600))})
    return out


def plain(raw):
    """(ms, hex, lat, lon, alt, ground, speed, callsign, squawk) of each record, one by one."""
    out, ms = [], None
    for k in range(0, len(raw) // 16 * 16, 16):
        a, b, c, d = struct.unpack_from("<Iiii", raw, k)
        if a == heatmap.MARKER:
            ms = (b << 32) + (c & 0xFFFFFFFF)
            continue
        if ms is None:
            continue
        name = ("~" if a & 0x1000000 else "") + f"{a & 0xFFFFFF:06x}"
        if b >= 1 << 30:
            sign = raw[k + 8 : k + 16].decode("latin-1").rstrip("\0").strip() or None
            out.append((ms, name, None, None, None, None, None, sign, str(b & 0xFFFF).zfill(4)))
            continue
        alt = struct.unpack_from("<h", raw, k + 12)[0]
        out.append((ms, name, b / 1e6, c / 1e6, None if alt == -123 else 25.0 * alt, alt == -123, None if d >> 16 == -1 else (d >> 16) / 10, None, None))
    return out


COLUMNS = ["slice_ms", "hex", "lat", "lon", "alt_ft", "on_ground", "gs_kt", "callsign", "squawk"]


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(5)
    for f in range(3):
        slices = [(1_700_000_000_000 + 1_800_000 * (10 * f + k), points(rng, int(rng.integers(0, 90)))) for k in range(9)]
        junk = b"\1\0\0\0" * 4 * f  # records before the first marker belong to no slice
        (tmp_path / f"{f}.bin.ttf").write_bytes(junk + heatmap.encode([*slices, (1_700_000_000_000 + 1_800_000 * (10 * f + 9), [])]))
    return tmp_path


def read(spark, folder, **options):
    heatmap.register(spark)
    return spark.read.format("heatmap").options(**options).load(f"file://{folder}").select("file", *COLUMNS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def everything(folder):
    return sorted(((p.name, *r) for p in folder.iterdir() for r in plain(p.read_bytes())), key=str)


@pytest.mark.parametrize("split", ["16", "800", "33554432"])
def test_files_are_split_within_and_no_slice_is_cut(spark, folder, split):
    df = read(spark, folder, split=split)
    assert rows(df) == everything(folder)
    assert (df.rdd.getNumPartitions() > 3) == (split != "33554432")


def test_filters_reach_the_source(spark, folder):
    want = everything(folder)
    some = want[17]
    cases = [
        (F.col("hex") == some[2], lambda r: r[2] == some[2]),
        (F.col("hex").isin(some[2], "nothing"), lambda r: r[2] == some[2]),
        ((F.col("lat") > 10) & (F.col("lat") <= 60) & (F.col("lon") >= -100) & (F.col("lon") < 50), lambda r: r[3] is not None and 10 < r[3] <= 60 and -100 <= r[4] < 50),
        ((F.col("slice_ms") >= some[1]) & (F.col("slice_ms") < some[1] + 3_600_000), lambda r: some[1] <= r[1] < some[1] + 3_600_000),
        ((F.col("file") == "1.bin.ttf") & (F.col("gs_kt") > 300), lambda r: r[0] == "1.bin.ttf" and (r[7] or 0) > 300),
    ]
    for filter_, keeps in cases:
        got = rows(read(spark, folder).filter(filter_))
        assert got == [r for r in want if keeps(r)] and got
    reader = heatmap.HeatmapReader({"path": f"file://{folder}"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    given = [EqualTo(("file",), "1.bin.ttf"), GreaterThanOrEqual(("slice_ms",), 5), EqualTo(("hex",), "~00000a")]
    assert list(reader.pushFilters(given)) == given
    assert [p.path.rpartition("/")[2] for p in reader.partitions()] == ["1.bin.ttf"] and reader.since == 5 and reader.addresses == {"~00000a"}


def test_latest_looks_into_one_slice_that_has_any(spark, folder):
    raw = (folder / "1.bin.ttf").read_bytes()
    s = heatmap.Slices(raw)
    rows_, of, looked = s.newest(heatmap.Wanted())
    assert looked == 2 and len(set(s.ms[of])) == 1  # the newest slice is empty
    full = plain(raw)
    last = max(r[0] for r in full)
    assert [tuple(r.values()) for r in s.batch(rows_, of, "x").select(COLUMNS).to_pylist()] == [r for r in full if r[0] == last]
    got = rows(read(spark, folder, latestOnly="true", bbox="-90,-180,90,180"))
    newest = {f: max(r[1] for r in everything(folder) if r[0] == f) for f in ("0.bin.ttf", "1.bin.ttf", "2.bin.ttf")}
    assert got == [r for r in everything(folder) if r[1] == newest[r[0]]]
    # of what an address has, not of what the newest slice has
    one = full[3][1]
    assert {r[2] for r in rows(read(spark, folder, latestOnly="true", hex=one))} == {one}


def test_columns_are_encoded_as_points_are():
    ms = np.array([5000, 5000, 9000])
    raw = heatmap.encode_columns(ms, np.array([1, 2, 3]), np.array([1.5, -2.25, 3.0]), np.array([4.0, 5.0, -6.5]), np.array([1000.0, 0, 50]), np.array([False, True, False]), np.array([12.0, np.nan, 99.9]))
    p = [{"hex": "000001", "lat": 1.5, "lon": 4.0, "alt_ft": 1000, "gs_kt": 12.0}, {"hex": "000002", "lat": -2.25, "lon": 5.0, "on_ground": True, "gs_kt": None}, {"hex": "000003", "lat": 3.0, "lon": -6.5, "alt_ft": 50, "gs_kt": 99.9}]
    assert raw == heatmap.encode([(5000, p[:2]), (9000, p[2:])])
