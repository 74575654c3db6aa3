"""Offsets of the firehose source, and what a log that was cut does."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tocsin.sources import firehose


def frames(lo, hi, operation="create"):
    n = list(range(lo, hi))
    return pa.table({"seq": n, "t": n, "did": ["a"] * len(n), "rkey": [str(x) for x in n], "operation": [operation] * len(n), "text": ["x"] * len(n)})


def read(reader, start, end):
    return sorted(x for p in reader.partitions(start, end) for b in reader.read(p) for x in b["seq"].to_pylist())


def test_every_frame_is_read_once_in_bounded_polls(tmp_path):
    pq.write_table(frames(0, 10), tmp_path / "a.parquet")
    pq.write_table(frames(10, 13), tmp_path / "b.parquet")
    pq.write_table(frames(0, 0), tmp_path / "none.parquet")
    reader, seen = firehose.FirehoseReader(f"file://{tmp_path}", "2", 5), []
    at = reader.initialOffset()
    for _ in range(3):
        end = reader.latestOffset()
        seen += read(reader, at, end)
        reader.commit(end)
        at = end
    assert seen == list(range(2, 13)) and at == {"seq": 13} == reader.latestOffset()
    pq.write_table(frames(13, 20), tmp_path / "c.parquet")  # more comes; a reader that begins anew goes on at the cursor
    anew = firehose.FirehoseReader(f"file://{tmp_path}", "0", 0)
    assert anew.latestOffset() == {"seq": 20} and read(anew, at, {"seq": 20}) == list(range(13, 20))
    assert firehose.FirehoseReader(f"file://{tmp_path}", "tail", 0).initialOffset() == {"seq": 20}


def test_a_cut_log_and_unknown_frames_are_errors(tmp_path):
    pq.write_table(frames(0, 3), tmp_path / "a.parquet")
    reader = firehose.FirehoseReader(f"file://{tmp_path}", "0", 0)
    with pytest.raises(ValueError, match="before the cursor"):
        reader.partitions({"seq": 9}, {"seq": 3})
    pq.write_table(frames(3, 4, "other"), tmp_path / "b.parquet")
    with pytest.raises(ValueError, match="unknown operation"):
        read(firehose.FirehoseReader(f"file://{tmp_path}", "0", 0), {"seq": 0}, {"seq": 4})
