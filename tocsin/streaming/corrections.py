"""Posts of a firehose with their corrections: a bounded map of what was taken, by author, in the state of transformWithState."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TITLE = 200
OUT = "did string, seq long, rkey string, status string, title string, matched boolean"


class Corrections(StatefulProcessor):
    """State of an author: the posts taken (key, number, title), at most `cap`, the longest untouched going first, and the last number.

    A post that matches is taken; an update or deletion of one that was taken is given whatever it says. Frames up to the last number
    are passed over, so a batch that comes again changes nothing.
    """

    def __init__(self, cap: int, ttl_ms: int | None):
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "rkey string", "seq long, title string", self.ttl_ms)
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        was = {k[0]: (v[0], v[1]) for k, v in self.taken.iterator()}
        now, out = dict(was), []
        for seq, rkey, operation, text, matched in pd.concat(rows).sort_values("seq")[["seq", "rkey", "operation", "text", "matched"]].itertuples(index=False, name=None):
            if seq <= last:
                continue
            last = int(seq)
            if not matched and rkey not in now:
                continue
            title = text[:TITLE] if matched else now[rkey][1]
            status = {"create": "current", "update": "updated", "delete": "cancelled"}[operation]
            out.append((key[0], last, rkey, status, title, bool(matched)))
            now.pop(rkey, None)
            if operation != "delete":
                now[rkey] = (last, title)
            while len(now) > self.cap:
                del now[min(now, key=lambda k: now[k][0])]
        for k in was.keys() - now.keys():
            self.taken.removeKey((k,))
        for k, v in now.items():
            if was.get(k) != v:
                self.taken.updateValue((k,), v)
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["did", "seq", "rkey", "status", "title", "matched"])

    def close(self) -> None:
        pass


def corrected_posts(frames: DataFrame, relevant: str, cap: int = 200, ttl_ms: int | None = None) -> DataFrame:
    """did, seq, rkey, status (current, updated or cancelled), title and matched of posts whose text matches the pattern `relevant`, and of
    the later commits to such posts. A deletion has no text and matches nothing; its title is the last one known."""
    text = F.when(F.col("operation") == "delete", "").otherwise(F.coalesce("text", F.lit("")))
    rows = frames.select("did", "seq", "rkey", "operation", text.alias("text")).withColumn("matched", F.col("text").rlike(relevant))
    return rows.groupBy("did").transformWithStateInPandas(Corrections(cap, ttl_ms), OUT, "append", "none")
