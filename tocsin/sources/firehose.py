"""A sequenced log of commits as a stream: a Python data source whose offsets are the durable cursor.

Frames lie in Parquet files of a folder, in any number of files; footers say which sequence numbers a file holds. An offset is the
next number to read, so a query that begins anew from its checkpoint reads each frame once and skips none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, t long, did string, rkey string, operation string, text string"
OPERATIONS = ("create", "update", "delete")


class FramePart(InputPartition):
    """Frames lo to hi (exclusive) of one file."""

    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


def seq_range(filesystem: fs.FileSystem, path: str) -> tuple[int, int] | None:
    """First and last number of a file by its footer; None if it has no rows."""
    with filesystem.open_input_file(path) as f:
        meta = pq.read_metadata(f)
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    if not sum(g.num_rows for g in groups):
        return None
    column = meta.schema.names.index("seq")
    stats = [g.column(column).statistics for g in groups if g.num_rows]
    return min(s.min for s in stats), max(s.max for s in stats)


class FirehoseReader(DataSourceStreamReader):
    """Offsets {"seq": next number}. max_frames bounds a poll; a query that resumes learns its place with the first batch it plans, so
    only the polls after that are bounded."""

    def __init__(self, path: str, since: str, max_frames: int):
        self.path, self.since, self.max_frames = path, since, max_frames
        self.at: int | None = None
        self.files: dict[str, tuple[int, int] | None] = {}

    def known(self) -> dict[str, tuple[int, int]]:
        """The files with rows and their ranges; a footer is read once."""
        filesystem, base = fs.FileSystem.from_uri(self.path)
        for info in filesystem.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = info.base_name
            if info.type == fs.FileType.File and name.endswith(".parquet") and not name.startswith(("_", ".")) and info.path not in self.files:
                self.files[info.path] = seq_range(filesystem, info.path)
        return {p: r for p, r in self.files.items() if r}

    def initialOffset(self) -> dict:
        """The number that `since` names, or what follows the newest frame: enrolment joins the live tail."""
        self.at = max((hi for _, hi in self.known().values()), default=-1) + 1 if self.since == "tail" else int(self.since)
        return {"seq": self.at}

    def latestOffset(self) -> dict:
        end = max((hi for _, hi in self.known().values()), default=-1) + 1
        if self.at is not None:
            end = max(self.at, min(end, self.at + self.max_frames) if self.max_frames else end)
        return {"seq": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = start["seq"], end["seq"]
        if hi < lo:
            raise ValueError(f"the log ends at {hi}, before the cursor {lo}: it was cut or replaced")
        self.at = hi
        return [FramePart(p, lo, hi) for p, (a, b) in sorted(self.known().items()) if a < hi and b >= lo]

    def read(self, partition: FramePart) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(self.path)
        with filesystem.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=["seq", "t", "did", "rkey", "operation", "text"]):
                b = b.filter(pc.and_(pc.greater_equal(b["seq"], partition.lo), pc.less(b["seq"], partition.hi)))
                if b.num_rows:
                    known = pc.is_in(b["operation"], pa.array(OPERATIONS))
                    if not pc.all(pc.and_(known, pc.and_(pc.is_valid(b["did"]), pc.is_valid(b["rkey"])))).as_py():
                        raise ValueError(f"frames of {partition.path} lack an identity or have an unknown operation")
                    yield b

    def commit(self, end: dict) -> None:
        """What lies before a committed offset is never asked for again."""
        self.files = {p: r for p, r in self.files.items() if r is None or r[1] >= end["seq"]} | {p: None for p, r in self.files.items() if r and r[1] < end["seq"]}


class Firehose(DataSource):
    """format("firehose"): options path (a folder's URI), since (a number, or tail) and maxFrames (of a poll; 0: no bound)."""

    @classmethod
    def name(cls) -> str:
        return "firehose"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FirehoseReader:
        return FirehoseReader(self.options["path"], self.options.get("since", "tail"), int(self.options.get("maxframes", self.options.get("maxFrames", "0"))))
