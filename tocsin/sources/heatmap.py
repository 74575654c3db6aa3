"""Binary point files: 16-byte records of four little-endian int32, in slices that begin with a marker record.

A marker record is (MARKER, high and low word of the slice's time in ms, 0). A point record is (address with flag and type
bits, latitude and longitude in millionths, speed in tenths of a knot above altitude in 25 ft). A latitude of 2**30 or more
marks a call sign record: the squawk in its low bits, eight characters in the last two words. Markers tell where slices lie, so
only those that are asked for are decoded, as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format.
MARKER, CALLSIGN_FROM, NON_ICAO, GROUND, NO_SPEED = 0x0E7F7C9D, 1 << 30, 0x1000000, -123, -1
SCHEMA = "file string, slice_ms long, hex string, type int, lat double, lon double, alt_ft double, on_ground boolean, gs_kt double, callsign string, squawk string"


def encode_columns(ms: np.ndarray, words: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt_ft: np.ndarray, on_ground: np.ndarray, gs_kt: np.ndarray) -> bytes:
    """A file of points in the order of their slices' times; words are addresses, a speed that is nan is unknown."""
    first = np.flatnonzero(np.diff(ms, prepend=ms[:1] - 1))
    rows = np.zeros((len(ms) + len(first), 4), np.int64)
    at = np.arange(len(ms)) + np.searchsorted(first, np.arange(len(ms)), side="right")
    marks = np.setdiff1d(np.arange(len(rows)), at)
    rows[marks, 0], rows[marks, 1], rows[marks, 2] = MARKER, ms[first] >> 32, ms[first] & 0xFFFFFFFF
    alt = np.where(on_ground, GROUND, np.rint(np.where(on_ground, 0, alt_ft) / 25)).astype(np.int64)
    speed = np.where(np.isnan(gs_kt), NO_SPEED, np.rint(np.nan_to_num(gs_kt) * 10)).astype(np.int64)
    rows[at] = np.stack([words, np.rint(lat * 1e6).astype(np.int64), np.rint(lon * 1e6).astype(np.int64), (speed & 0xFFFF) << 16 | alt & 0xFFFF], axis=1)
    return (rows & 0xFFFFFFFF).astype("<u4").tobytes()


def encode(slices: list[tuple[int, list[dict]]]) -> bytes:
    """A file of (time in ms, points); a point has hex and either lat, lon, alt_ft (or on_ground) and gs_kt, or callsign and squawk."""
    rows = []
    for ms, points in slices:
        rows.append((MARKER, ms >> 32, ms & 0xFFFFFFFF, 0))
        for p in points:
            address = int(p["hex"].lstrip("~"), 16) | (NON_ICAO if p["hex"][0] == "~" else 0) | p.get("type", 0) << 27
            if p.get("squawk") is not None:
                name = (p.get("callsign") or "").ljust(8, "\0").encode()[:8]
                rows.append((address, CALLSIGN_FROM | int(p["squawk"]), *np.frombuffer(name, "<u4").tolist()))
            else:
                alt = GROUND if p.get("on_ground") else round(p["alt_ft"] / 25)
                speed = NO_SPEED if p.get("gs_kt") is None else round(p["gs_kt"] * 10)
                rows.append((address, round(p["lat"] * 1e6), round(p["lon"] * 1e6), (speed & 0xFFFF) << 16 | alt & 0xFFFF))
    return (np.array(rows, np.int64).reshape(-1, 4) & 0xFFFFFFFF).astype("<u4").tobytes()


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def strings(cells: np.ndarray, size: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes, of which the first size count, as text."""
    size = size if valid is None else np.where(valid, size, 0)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = cells[np.arange(cells.shape[1]) < size[:, None]]
    mask = None if valid is None else pa.array(np.packbits(valid, bitorder="little")).buffers()[1]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()), mask)


def hex_names(words: np.ndarray) -> pa.Array:
    """Six digits of each address, after a tilde where it isn't an ICAO one."""
    digits = HEX[(words[:, None] >> np.arange(20, -4, -4, dtype=np.uint32)) & np.uint32(15)]
    other = (words & np.uint32(NON_ICAO)) != 0
    cells = np.concatenate([np.where(other[:, None], np.uint8(126), digits[:, :1]), np.where(other[:, None], digits, np.roll(digits, -1, axis=1))], axis=1)
    return strings(cells, np.where(other, 7, 6))


def call_names(words: np.ndarray, named: np.ndarray) -> pa.Array:
    """Call signs of eight Latin-1 characters, stripped; null where there is none. Each distinct one is decoded once."""
    raw = np.ascontiguousarray(words[named]).view("<u8").ravel()
    values, at = np.unique(raw, return_inverse=True)
    text = pa.array([v.tobytes().decode("latin-1").rstrip("\0").strip() or None for v in values], pa.string())
    of = np.full(len(named), -1)
    of[named] = at
    return text.take(pa.array(of, mask=of < 0))


@dataclass(frozen=True)
class Wanted:
    """What of a file is asked for: a box (degrees: south, west, north, east), addresses, times of slices in ms (both ends included)."""

    bbox: tuple[float, float, float, float] | None = None
    addresses: frozenset[str] | None = None
    since: int = -(1 << 62)
    until: int = 1 << 62

    def words(self) -> np.ndarray:
        return np.array([int(h.lstrip("~"), 16) | (NON_ICAO if h[0] == "~" else 0) for h in self.addresses], np.uint32)


class Slices:
    """The slices of a piece of a file, by their markers: first record, end, and time in ms of each."""

    def __init__(self, raw: bytes):
        self.u = np.frombuffer(raw, "<u4", len(raw) // 16 * 4).reshape(-1, 4)
        marks = np.flatnonzero(self.u[:, 0] == MARKER)
        self.first, self.end = marks + 1, np.append(marks[1:], len(self.u))
        self.ms = (self.u[marks, 1].astype(np.int64) << 32) + self.u[marks, 2]

    def rows(self, which: np.ndarray, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
        """Records of the slices that are wanted, and the slice of each."""
        which = which[(self.ms[which] >= wanted.since) & (self.ms[which] <= wanted.until)]
        size = self.end[which] - self.first[which]
        rows = np.repeat(self.first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of = np.repeat(which, size)
        keep = np.ones(len(rows), bool)
        i = self.u.view("<i4")
        if wanted.bbox:
            south, west, north, east = (x * 1e6 for x in wanted.bbox)
            lat, lon = i[rows, 1], i[rows, 2]
            keep = (lat >= CALLSIGN_FROM) | ((lat >= south) & (lat <= north) & (lon >= west) & (lon <= east))
        if wanted.addresses is not None:
            keep &= np.isin(self.u[rows, 0] & np.uint32(0x1FFFFFF), wanted.words())
        return rows[keep], of[keep]

    def newest(self, wanted: Wanted) -> tuple[np.ndarray, np.ndarray, int]:
        """rows() of the newest slice that has any (of one time: all), and how many slices were looked into."""
        looked = 0
        for ms in np.unique(self.ms)[::-1]:
            which = np.flatnonzero(self.ms == ms)
            rows, of = self.rows(which, wanted)
            looked += len(which)
            if len(rows):
                return rows, of, looked
        return np.zeros(0, np.int64), np.zeros(0, np.int64), looked

    def batch(self, rows: np.ndarray, of: np.ndarray, file: str) -> pa.RecordBatch:
        u = self.u[rows]
        i = u.view("<i4")
        named = i[:, 1] >= CALLSIGN_FROM
        alt = (u[:, 3] & np.uint32(0xFFFF)).astype(np.uint16).view(np.int16)
        ground = (alt == GROUND) & ~named
        speed = i[:, 3] >> 16
        squawk = u[:, 1] & np.uint32(0xFFFF)
        digits = (squawk[:, None] // np.array([10000, 1000, 100, 10, 1], np.uint32) % np.uint32(10) + np.uint32(48)).astype(np.uint8)
        long = squawk >= 10000
        f = pa.float64()
        return pa.RecordBatch.from_pydict({
            "file": pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(rows), np.int32)), pa.array([file])).cast(pa.string()), "slice_ms": pa.array(self.ms[of]), "hex": hex_names(u[:, 0]),
            "type": pa.array((u[:, 0] >> np.uint32(27)).astype(np.int32)), "lat": pa.array(i[:, 1] / 1e6, f, mask=named), "lon": pa.array(i[:, 2] / 1e6, f, mask=named),
            "alt_ft": pa.array(alt.astype(float) * 25, f, mask=named | ground), "on_ground": pa.array(ground, pa.bool_(), mask=named), "gs_kt": pa.array(speed / 10, f, mask=named | (speed == NO_SPEED)),
            "callsign": call_names(u[:, 2:], named), "squawk": strings(np.where(long[:, None], digits, np.roll(digits, -1, axis=1)), np.where(long, 5, 4), named),
        })


def decode(raw: bytes, file: str, latest_only: bool = False, bbox: tuple | None = None, addresses: set[str] | None = None) -> pa.RecordBatch:
    """All records (or those of the newest slice that has any, in the box and of the addresses)."""
    s, wanted = Slices(raw), Wanted(bbox, frozenset(addresses) if addresses else None)
    return s.batch(*(s.newest(wanted)[:2] if latest_only else s.rows(np.arange(len(s.ms)), wanted)), file)


#: Bytes of a file that one partition reads, and bytes of an Arrow batch's records.
SPLIT, BATCH = 32 << 20, 8 << 20


@dataclass
class PointRange(InputPartition):
    """Slices whose markers lie in bytes lo to hi of a file."""

    path: str
    lo: int
    hi: int


class HeatmapReader(DataSourceReader):
    """Options: path (a folder), latestOnly, bbox ("lat,lon,lat,lon"), hex (comma-joined addresses), split (bytes of a partition).

    Comparisons of file, hex, slice_ms, lat and lon with constants are pushed down: files and slices that cannot match are not read or
    passed over by their markers, and records are compared as integers before anything is decoded. Files are split within; a slice
    belongs to the part that holds its marker. With latestOnly a file is one part, as only all markers tell the newest slice.
    """

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.latest = options.get("latestonly", "false").lower() == "true"
        self.bbox = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        self.addresses = frozenset(options["hex"].split(",")) if options.get("hex") else None
        self.split = max(16, int(options.get("split", SPLIT)) // 16 * 16)
        self.since, self.until, self.files = -(1 << 62), 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All are given back: they are cheap to look at again. With latestOnly only files are, as the newest slice that has any depends on
        what is asked by options alone."""
        south, west, north, east = self.bbox or (-1e4, -1e4, 1e4, 1e4)
        for f in filters:
            yield f
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "file" and values is not None:
                self.files = values if self.files is None else self.files & values
            if self.latest or name is None:
                continue
            if name == "hex" and values is not None:
                known = frozenset(h for h in values if re.fullmatch("~?[0-9a-f]{6}", h or ""))
                self.addresses = known if self.addresses is None else self.addresses & known
            lo = f.value if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
            hi = f.value if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
            if name == "slice_ms":
                self.since, self.until = max(self.since, lo if lo is not None else self.since), min(self.until, hi if hi is not None else self.until)
            if name == "lat":
                south, north = max(south, lo if lo is not None else south), min(north, hi if hi is not None else north)
            if name == "lon":
                west, east = max(west, lo if lo is not None else west), min(east, hi if hi is not None else east)
        if (south, west, north, east) != (-1e4, -1e4, 1e4, 1e4):
            self.bbox = (south, west, north, east)

    def partitions(self) -> Sequence[InputPartition]:
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        found = [f for f in filesystem.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(".bin.ttf")]
        found = sorted((f for f in found if self.files is None or f.base_name in self.files), key=lambda f: f.path)
        step = (lambda size: max(size, 16)) if self.latest else (lambda size: self.split)
        return [PointRange(f.path, lo, min(lo + step(f.size), f.size)) for f in found for lo in range(0, f.size, step(f.size))]

    def read(self, partition: PointRange) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(self.folder)
        wanted, file = Wanted(self.bbox, self.addresses, self.since, self.until), partition.path.rpartition("/")[2]
        with filesystem.open_input_file(partition.path) as f:
            f.seek(partition.lo)
            raw = f.read(partition.hi - partition.lo)
            if self.latest:
                s = Slices(raw)
                yield s.batch(*s.newest(wanted)[:2], file)
                return
            raw += rest_of_slice(f)
        s = Slices(raw)
        ends = np.searchsorted(s.end, np.arange(BATCH // 16, len(s.u) + BATCH // 16, BATCH // 16))
        lo = 0
        for hi in [*(ends + 1).tolist(), len(s.ms)]:
            hi = min(hi, len(s.ms))
            if hi > lo:
                yield s.batch(*s.rows(np.arange(lo, hi), wanted), file)
            lo = max(lo, hi)


def rest_of_slice(f) -> bytes:
    """What follows in a file up to the next marker."""
    out = []
    while piece := f.read(1 << 20):
        marks = np.flatnonzero(np.frombuffer(piece, "<u4", len(piece) // 16 * 4).reshape(-1, 4)[:, 0] == MARKER)
        out.append(piece[: 16 * int(marks[0])] if len(marks) else piece)
        if len(marks):
            break
    return b"".join(out)


class HeatmapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heatmap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeatmapReader(self.options)


def register(spark: SparkSession) -> None:
    """Also lets Python sources see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeatmapSource)
