"""Problems of a box from check to check, and the pages that they are worth.

Spans of a problem are islands over the box's checks, found by windows. What of a page depends on the pages before it is settled by
a walk over the sightings of one box, which come in their order as spans, ages and counts.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed values, in seconds: how long a problem must last and be away, and is remembered; until it is paged again, and what counts as old.
HOLD, CLEAR, MEMORY, AGAIN, OLD = 180, 600, 86400, 6 * 3600, 86400
#: Pages handed on at once.
BATCH = 1000


def problem_name(text) -> F.Column:
    """What names a problem: what stands before its first parenthesis, whatever its numbers."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s) \(.*$", ""), r"\d+(\.\d+)?", "#")


def problem_spans(checks: DataFrame) -> DataFrame:
    """box, name, t, text, span (numbered from 0), opened, checks and seen (of the span so far), ended (when it is found to be over, null if
    it isn't), whole_checks and whole_seen (of the span), back (whether the span before ended less than MEMORY earlier) of each sighting.

    checks: box, t, problem (null for a check that finds none). A span is over at the first check at least CLEAR after its last
    sighting. Repeated rows count once; of texts of one name at one check the last in order stays.
    """
    box, line = Window.partitionBy("box"), ["box", "name"]
    times = checks.select("box", "t").distinct()
    times = times.withColumn("i", F.row_number().over(box.orderBy("t"))).withColumn("before", F.lag("t").over(box.orderBy("t")))
    seen = checks.filter("problem is not null").groupBy("box", problem_name(F.col("problem")).alias("name"), "t").agg(F.max("problem").alias("text")).join(times, ["box", "t"])
    by = Window.partitionBy(*line).orderBy("t")
    seen = seen.withColumn("new", F.coalesce(F.col("before") - F.lag("t").over(by) >= CLEAR, F.lit(False)).cast("int"))
    seen = seen.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = seen.groupBy(*line, "span").agg(F.min("t").alias("opened"), F.max("t").alias("last"), F.min("i").alias("i0"), F.count("*").alias("whole_seen"))
    # the first check at or after last + CLEAR: the checks and these moments in one order
    marks = spans.select("box", (F.col("last") + CLEAR).alias("t"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("i"), "name", "span")
    both = times.select("box", "t", F.col("t").alias("at"), "i", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("span")).unionByName(marks)
    after = box.orderBy(F.desc("t"), F.col("at").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, 0)  # backwards, so that it runs on
    ends = both.withColumn("ended", F.min("at").over(after)).withColumn("end_i", F.min("i").over(after)).filter("span is not null").select(*line, "span", "ended", "end_i")
    spans = spans.join(ends, [*line, "span"]).withColumn("whole_checks", F.col("end_i") - F.col("i0"))
    spans = spans.withColumn("ended_before", F.lag("ended").over(Window.partitionBy(*line).orderBy("span"))).drop("last", "end_i")
    out = seen.drop("new").join(spans, [*line, "span"])
    first_before = F.first("before").over(Window.partitionBy(*line, "span").orderBy("t"))
    out = out.withColumn("checks", F.col("i") - F.col("i0") + 1).withColumn("seen", F.row_number().over(Window.partitionBy(*line, "span").orderBy("t")))
    out = out.withColumn("back", F.coalesce(first_before - F.col("ended_before") < MEMORY, F.lit(False)))
    return out.select(*line, "t", "text", "span", "opened", "checks", "seen", "ended", "whole_checks", "whole_seen", "back")


def next_page(opened: int, paged: int) -> int:
    """When a problem that was paged is to be paged again: each AGAIN while it is young, as it gets old, then once in OLD."""
    old = opened + OLD
    return paged + OLD if paged >= old else min(old, paged + AGAIN)


@dataclass
class Problem:
    """The latest span of one name in one box, as far as it is told."""

    opened: int
    whole: tuple[int, int]
    carried: tuple[int, int] = (0, 0)
    paged: int | None = None
    told: int | None = None
    live: bool = True
    text: str = ""


def pages_of(sightings: Iterable, upstream: tuple[str, ...] = ()) -> Iterator[tuple[int, str, str, list[str]]]:
    """(t, kind, priority, texts) of one box's pages, from its rows of problem_spans() in the order of t and name.

    A problem counts once it is HOLD old and was present at half of its checks or more. A span goes on with the age and counts of the
    one before if that was paged and is remembered. A page lists all problems that count at its check; it is worth one when any is
    due. Where nothing that was paged is left open, the end of what was paged is a page too, once. A span is over before the next of
    its name begins, so that what is kept is one span a name.
    """
    latest: dict[str, Problem] = {}
    ends: list[tuple[int, str]] = []

    def check(t: int, rows: list) -> Iterator[tuple[int, str, str, list[str]]]:
        over, listed = [], []
        while ends and ends[0][0] == t:
            over.append(latest[heappop(ends)[1]])
        for r in rows:
            if r.seen == 1:
                was, now = latest.get(r.name), Problem(r.opened, (r.whole_checks, r.whole_seen))
                if r.back and was and was.paged is not None:
                    now.opened, now.paged, now.told = was.opened, was.paged, was.told
                    now.carried = (was.carried[0] + was.whole[0], was.carried[1] + was.whole[1])
                latest[r.name] = now
                if r.ended is not None:
                    heappush(ends, (r.ended, r.name))
            p = latest[r.name]
            p.text = r.text
            if t - p.opened >= HOLD and 2 * (p.carried[1] + r.seen) >= p.carried[0] + r.checks:
                listed.append((p.opened, r.text, p, r.name.startswith(upstream) if upstream else False))
        for p in over:
            p.live = False
        gone = [p for p in over if p.paged is not None and p.paged > (p.told or 0)]
        if any(p.paged is None or (not theirs and t >= next_page(p.opened, p.paged)) for _, _, p, theirs in listed):
            listed.sort(key=lambda x: x[:2])
            own = [x for x in listed if not x[3]]
            yield t, "alert", "default" if not own else "urgent" if t - own[0][0] >= OLD else "high", [x[1] for x in listed]
            for x in listed:
                x[2].paged = t
        elif gone and not any(p.live and p.paged is not None for p in latest.values()):
            yield t, "recovery", "default", sorted(p.text for p in gone)
            for p in gone:
                p.told = t

    for t, rows in groupby(sightings, key=lambda r: r.t):
        while ends and ends[0][0] < t:
            yield from check(ends[0][0], [])
        yield from check(t, list(rows))
    while ends:
        yield from check(ends[0][0], [])


def problem_pages(checks: DataFrame, upstream: tuple[str, ...] = ()) -> DataFrame:
    """box, t, kind (alert or recovery), priority, problems (texts) of the pages that the checks (box, t in seconds, problem; null for a
    check that finds none) of each box are worth. Problems whose name begins with one of upstream are a third party's: they are paged
    once and are never urgent. A box's sightings pass through one task in their order, a batch at a time."""
    columns = ["box", "name", "t", "text", "opened", "checks", "seen", "ended", "whole_checks", "whole_seen", "back"]
    row = namedtuple("Sighting", columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(*r) for part in parts for r in zip(*(part.column(c).to_pylist() for c in columns)))
        pages = ((box, *page) for box, own in groupby(rows, key=lambda r: r.box) for page in pages_of(own, upstream))
        while some := list(islice(pages, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*some), kinds)], names=["box", "t", "kind", "priority", "problems"])

    kind = checks.schema["box"].dataType
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
    spans = problem_spans(checks.select("box", F.col("t").cast("long").alias("t"), "problem")).select(*columns)
    return spans.repartition("box").sortWithinPartitions("box", "t", "name").mapInArrow(run, f"box {kind.simpleString()}, t long, kind string, priority string, problems array<string>")
