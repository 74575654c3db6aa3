"""WARC archives: a Python data source that writes and reads them, and revisit records for repeated payloads.

Writing: each task makes archives of at most ARCHIVE_BYTES, beside each an index of its records' offsets, and reports their names;
on commit the driver lists the successful tasks' archives in one manifest, so a reader never sees a lost attempt's file.

Reading: the reader plans partitions of archives and, by offset, of parts of large ones. Comparisons of record_type, page_id,
payload_digest, target_uri and refers_to are pushed down. Of each record only the header lines are parsed first; where they fail
the predicates the reader goes on to the next offset, and where no payload is wanted (option "payload" false) too, so that block is
never decoded. A folder without a manifest, and an archive without an index, are read from record to record. A gzip member
holds one record, compressed on its own; headers are read from its first bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import operator
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .common import free_name, parts, shared_dir, table, written

ARCHIVE_BYTES = 64 << 20
#: Archives, or parts of one, planned into one read partition, by their size together.
SPLIT_BYTES = 16 << 20
#: Rows and bytes of payload that the reader hands on at once.
READ_ROWS, READ_BYTES = 1000, 4 << 20
#: Up to so many repeated digests (of some 60 bytes each) are sent to all tasks; beyond it pages meet them in a shuffle.
BROADCAST_DIGESTS = 200_000
#: No more keys than this are called hot, whatever the input: a key with a share of 1 / HOT_KEYS of the rows.
HOT_KEYS = 1000
COLUMNS = ("page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload")
SCHEMA = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload string"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    text = record.rpartition(":")[2].rstrip(">")
    return int(text) if text else None


def record(page_id, kind: str, uri: str | None, size: int, digest: str, refers_to, payload: str | None) -> bytes:
    """One record: a response with its payload, or a revisit, whose HTTP head still tells the payload's length. The digest may be in
    hexadecimal digits."""
    body = (payload or "").encode() if kind == "response" else b""
    if len(digest) == 40:
        digest = base64.b32encode(bytes.fromhex(digest)).decode()
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + http + body + CRLF + CRLF


@dataclass
class Archives(ds.WriterCommitMessage):
    files: list = field(default_factory=list)


@dataclass
class Files(ds.InputPartition):
    """Archives by name, with the range of offsets in which the records to be read begin."""

    spans: list = field(default_factory=list)


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.archive_bytes = int(options.get("archivebytes", ARCHIVE_BYTES))
        self.compressed = options.get("compression", "gzip") == "gzip"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archives:
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        filesystem.create_dir(base)
        out, stream, offsets = Archives(), None, [0]

        def close() -> None:
            nonlocal stream, offsets
            stream.close()
            out.files[-1][1] = offsets[-1]
            with filesystem.open_output_stream(f"{base}/{out.files[-1][0]}.idx", compression=None) as f:
                f.write(np.array(offsets, "<i8").tobytes())
            stream, offsets = None, [0]

        for batch in parts(batches, "payload"):
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                raw = record(*row)
                if self.compressed:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                if stream is not None and offsets[-1] + len(raw) > self.archive_bytes:
                    close()
                if stream is None:
                    name = f"{uuid.uuid4().hex}.warc{'.gz' * self.compressed}"
                    stream = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                    out.files.append([name, 0])
                stream.write(raw)
                offsets.append(offsets[-1] + len(raw))
        if stream is not None:
            close()
        return out

    def commit(self, messages: list) -> None:
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        filesystem.create_dir(base)
        listed = sorted(f for m in messages if m for f in m.files)
        with filesystem.open_output_stream(f"{base}/manifest.tmp") as f:
            f.write(json.dumps(listed).encode())
        filesystem.move(f"{base}/manifest.tmp", f"{base}/manifest.json")

    def abort(self, messages: list) -> None:
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        for name in [n for m in messages if m for n, _ in m.files]:
            for path in (f"{base}/{name}", f"{base}/{name}.idx"):
                try:
                    filesystem.delete_file(path)
                except FileNotFoundError:
                    continue


class Members:
    """The bytes of an archive's records in turn: read() and skip() inside one, next() goes on to the following, by its offset where
    offsets (the records' and the end) are known."""

    def __init__(self, stream, compressed: bool, offsets: np.ndarray | None = None, chunk: int = 1 << 18):
        self.stream, self.compressed, self.chunk = stream, compressed, chunk
        self.raw, self.buffer, self.z = b"", b"", None
        self.starts = iter(() if offsets is None else zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        self.known, self.at, self.end = offsets is not None, 0, None

    def fetch(self) -> bytes:
        """More bytes of the file; of known records none beyond the last byte of the one at hand, unless they come in the same chunk."""
        got = self.stream.read(self.chunk)
        self.at += len(got)
        return got

    def more(self) -> bool:
        """Decode a little more of the record; false at its end."""
        if not self.compressed:
            if not self.raw:
                self.raw = self.fetch()
            left = len(self.raw) if self.end is None else max(0, min(len(self.raw), self.end - (self.at - len(self.raw))))
            self.buffer += self.raw[:left]
            self.raw = self.raw[left:]
            return left > 0
        while True:
            if self.z.eof:
                return False
            if not self.raw:
                self.raw = self.fetch()
                if not self.raw:
                    return False
            got = self.z.decompress(self.raw, 4096)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def next(self) -> bool:
        if self.known:
            start, self.end = next(self.starts, (None, None))
            if start is None:
                return False
            have = self.at - len(self.raw)
            if have <= start < self.at:
                self.raw = self.raw[start - have :]
            else:
                self.stream.seek(start)
                self.raw, self.at = b"", start
            self.buffer = b""
            self.z = zlib.decompressobj(31) if self.compressed else None
            return True
        if self.compressed:
            if self.z is not None:  # what is left of this member is inflated only to find its end, and not kept
                while not self.z.eof:
                    self.buffer = b""
                    if not self.more():
                        break
            self.buffer = b""
            if not self.raw:
                self.raw = self.fetch()
            self.z = zlib.decompressobj(31)
            return bool(self.raw)
        return bool(self.buffer) or self.more()

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark, which is passed."""
        while mark not in self.buffer:
            if not self.more():
                raise ValueError("a record ends within its head")
        head, _, self.buffer = self.buffer.partition(mark)
        return head

    def read(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self.more():
                raise ValueError("a record ends within its block")
            parts.append(self.buffer)
            have += len(self.buffer)
        out = b"".join(parts)
        self.buffer = out[n:]
        return out[:n]

    def skip(self, n: int) -> None:
        while len(self.buffer) < n:
            n -= len(self.buffer)
            self.buffer = b""
            if not self.more():
                raise ValueError("a record ends within its block")
        self.buffer = self.buffer[n:]


#: What a pushed comparison asks of a header's value; a missing value fails all but the first.
TESTS = {
    "IsNull": lambda x, v: x is None, "IsNotNull": lambda x, v: True, "EqualTo": operator.eq, "In": lambda x, v: x in v,
    "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le,
    "StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": operator.contains,
}


class Reader(ds.DataSourceReader):
    PUSHED = {"record_type", "page_id", "payload_digest", "target_uri", "refers_to"}

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.accept: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            test = type(f).__name__
            if test in TESTS and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                self.accept.append((f.attribute[0], test, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        if filesystem.get_file_info(f"{base}/manifest.json").type == fs.FileType.File:
            with filesystem.open_input_stream(f"{base}/manifest.json", compression=None) as f:
                listed = json.loads(f.read())
        else:
            found = filesystem.get_file_info(fs.FileSelector(base))
            listed = sorted([f.base_name, f.size] for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        spans = [(name, lo, min(lo + self.split_bytes, n)) for name, n in listed for lo in range(0, n, self.split_bytes)]
        out, size = [], 0
        for name, lo, hi in spans:
            if not out or size + hi - lo > self.split_bytes:
                out.append(Files())
                size = 0
            out[-1].spans.append((name, lo, hi))
            size += hi - lo
        return out or [Files()]

    def offsets(self, filesystem, path: str, lo: int, hi: int) -> np.ndarray | None:
        """Of the records that begin from lo to before hi, and where the last of them ends; none where there is no index."""
        if filesystem.get_file_info(f"{path}.idx").type != fs.FileType.File:
            return None
        with filesystem.open_input_stream(f"{path}.idx", compression=None) as f:
            at = np.frombuffer(f.read(), "<i8")
        a, b = np.searchsorted(at[:-1], [lo, hi])
        return at[a : b + 1] if b > a else at[:0]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(self.folder)
        held, size = [], 0
        for name, lo, hi in partition.spans:
            at = self.offsets(filesystem, f"{base}/{name}", lo, hi)
            if at is None and lo or at is not None and not len(at):
                continue  # an archive without an index is read whole, with its first part
            with filesystem.open_input_file(f"{base}/{name}") as stream:
                members = Members(stream, name.endswith(".gz"), at)
                while members.next():
                    row = self.record(members)
                    if row is not None:
                        held.append(row)
                        size += len(row[-1] or "")
                        if len(held) >= READ_ROWS or size >= READ_BYTES:
                            yield self.batch(held)
                            held, size = [], 0
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(COLUMNS))

    def accepted(self, seen: dict) -> bool:
        return all((seen[name] is not None or test == "IsNull") and TESTS[test](seen[name], value) for name, test, value in self.accept)

    def record(self, m: Members) -> tuple | None:
        lines = m.until(CRLF + CRLF).decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n, kind = int(head["Content-Length"]), head["WARC-Type"]
        seen = {
            "record_type": kind, "page_id": page_of(head["WARC-Record-ID"]), "target_uri": head.get("WARC-Target-URI"),
            "payload_digest": head["WARC-Payload-Digest"].partition(":")[2], "refers_to": page_of(head["WARC-Refers-To"]) if kind == "revisit" else None,
        }
        if not self.accepted(seen):
            if not m.known:
                m.skip(n + 4)
            return None
        http = m.until(CRLF + CRLF)
        size = int(http.lower().rpartition(b"content-length: ")[2].split(CRLF)[0])
        body = n - len(http) - 4
        payload = None
        if kind == "response" and self.payload:
            payload = m.read(body)
            if len(payload) != size or payload_digest(payload) != seen["payload_digest"]:
                raise ValueError(f"the payload of {head['WARC-Record-ID']} differs from its digest")
            payload = payload.decode()
            m.skip(4)
        elif not m.known:
            m.skip(body + 4)
        return seen["page_id"], kind, seen["target_uri"], size, seen["payload_digest"], seen["refers_to"], payload


class WarcSource(ds.DataSource):
    """After register(spark), format("warc") reads and writes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows (left) with the columns of groups (one row per key, with the count `size` of rows that have it).

    Keys with over 1 / HOT_KEYS of all rows, at most HOT_KEYS of them, are joined by a broadcast; so no task of the
    shuffled join gets one key's rows beyond that share.
    """
    hot = groups.filter(F.col(size) * HOT_KEYS > total)
    flag = free_name(rows, "_hot")
    hot_keys = F.broadcast(hot.select(key, F.lit(True).alias(flag)))
    split = rows.join(hot_keys, key, "left")
    one = split.filter(F.col(flag)).drop(flag).join(F.broadcast(hot), key)
    rest = split.filter(F.col(flag).isNull()).drop(flag).join(groups.filter(F.col(size) * HOT_KEYS <= total), key)
    return one.unionByName(rest)


def revisits(pages: DataFrame, id_col: str, uri_col: str, html_col: str) -> DataFrame:
    """Rows ready for the writer: of pages with equal payloads the one of the largest id is the response, the others revisit it.

    Null html is an empty payload, and equal to other empty ones. Rows of that id and payload are all responses, so repeated rows stay
    whole; a null id is lower than all others. An empty table makes no archive; other columns of pages are left out. Only digests
    that are repeated are joined to the pages: by broadcast, or where there are more than BROADCAST_DIGESTS of them by a
    shuffle in which the pages of a hot digest are dealt to all tasks.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload")
    ).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = rows.groupBy("sha").agg(F.count("*").alias("n_same"), F.max("page_id").alias("last")).filter("n_same > 1")
    groups = written(groups.select("sha", "n_same", "last", F.lit(True).alias("again")), "payloads")
    n = groups.agg(F.count("*").alias("n"), F.sum("n_same").alias("rows")).first()
    if n.n <= BROADCAST_DIGESTS:
        out = rows.join(F.broadcast(groups.drop("n_same")), "sha", "left")
    else:
        hot = groups.filter(F.col("n_same") * HOT_KEYS > n.rows).select("sha", F.col("last").alias("hot_last"), F.col("again").alias("hot"))
        out = rows.join(F.broadcast(hot), "sha", "left")
        key = F.when(F.col("hot"), F.concat(F.lit("-"), F.xxhash64("page_id", "target_uri").cast("string"))).otherwise(F.col("sha"))
        rest = groups.filter(F.col("n_same") * HOT_KEYS <= n.rows).select(F.col("sha").alias("key"), "last", "again")
        out = out.withColumn("key", key).join(rest, "key", "left")
        out = out.withColumn("last", F.coalesce("hot_last", "last")).withColumn("again", F.coalesce("hot", "again"))
    response = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    return out.select(
        "page_id", F.when(response, "response").otherwise("revisit").alias("record_type"), "target_uri", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("sha").alias("payload_digest"), F.when(~response, F.col("last")).alias("refers_to"), F.when(response, F.col("payload")).alias("payload"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives; odd rows as in revisits()."""
    register(spark)
    folder = f"{shared_dir(spark)}/tocsin-warc-{uuid.uuid4().hex}"
    revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html").write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder)
    return back.drop("target_uri", "payload")
