"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words: a word of the benchmark has a number from 1, every other word is 0. Windows of the same length m
share a scanner. Its shift table is indexed by blocks of two words (of one, for m = 1) and says how far the window may
move; a block that ends no window gives 0 only where some window ends so. There the hash of the window's last block
selects a bucket, and the text's window is looked up among those in it, which compares them word by word.

The benchmark is sent to the tasks in shards of about SHARD_BYTES, one at a time. Where one holds it all, as benchmarks are meant
to be, each document is scanned where it is read and never shuffled. A larger one means a pass over the documents for each shard;
what a pass finds is written by the text's digest, and meets the documents at the end.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, free_name, per_row, table, words_alnum, written

WINDOW = 10
#: The benchmark text that goes to the tasks in one pass, about; an item is never split.
SHARD_BYTES = 2 << 20
#: Digests of texts with a hit that may be sent to all tasks at the end; beyond it they meet the documents in a shuffle.
BROADCAST_TEXTS = 20_000


class WuManber:
    """The windows of some items; find() gives their occurrences in a list of words."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_alnum(text)]
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                owners[tuple(w[i : i + m])].add(item)
        by_length: dict[int, list] = defaultdict(list)
        for pattern, of in owners.items():
            by_length[len(pattern)].append((pattern, frozenset(of)))
        self.scanners = []
        for m, patterns in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            buckets: dict = defaultdict(dict)
            for pattern, of in patterns:
                for end in range(block, m + 1):
                    key = pattern[end - block : end]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[pattern[m - block :]][pattern] = of
            self.scanners.append((m, block, shift, dict(buckets)))

    def find(self, words: list[bytes]) -> Iterable[tuple[int, int, frozenset]]:
        """(start, length, items) of every occurrence of a window, overlapping ones too."""
        number = self.number.get
        ids = [number(w, 0) for w in words]
        n = len(ids)
        for m, block, shift, buckets in self.scanners:
            far, at, get = m - block + 1, m, shift.get
            while at <= n:  # the window's end
                key = (ids[at - 2], ids[at - 1]) if block == 2 else (ids[at - 1],)
                step = get(key, far)
                if step:
                    at += step
                    continue
                start = at - m
                of = buckets[key].get(tuple(ids[start:at])) if key in buckets else None
                if of is not None:
                    yield start, m, of
                at += 1


def shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int | None = None) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items, ids as text, in lists of about so many bytes, each fetched when it is asked for; the last comes alone."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // (shard_bytes or SHARD_BYTES) + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [(r.i, bytes(r.t) if r.t is not None else None) for r in (items if n == 1 else items.filter(part == k)).collect()]


#: The worker's scanner, by a name of its shard.
SCANNER: dict[str, WuManber] = {}


def scanned(docs: DataFrame, text_col: str, items: list, window: int, name: str, keep: list[str]) -> DataFrame:
    """keep's columns of docs and a struct `name`: n_words, hits, items, of one shard."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    number = uuid.uuid4().hex

    def make():
        if number not in SCANNER:
            SCANNER.clear()
            SCANNER[number] = WuManber(shared.value, window)
        scan = SCANNER[number]

        def f(text):
            words = words_alnum(text)
            spans, of = [], set()
            for start, m, owners in scan.find(words):
                spans.append((start, start + m))
                of |= owners
            return len(words), merged(spans), sorted(of)

        return f

    return per_row(docs, text_col, make, FIELDS, name, keep)


FIELDS = "n_words long, hits array<struct<s:int,e:int>>, items array<string>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shard_bytes: int | None = None, name: str = "contamination",
) -> DataFrame:
    """docs with a struct `name`: n_words, hits (array of [start, end) word spans, merged and in order), items (distinct
    item ids as text, sorted as text). A column of that name in docs is replaced.

    Null or wordless text: no words, no hits. A null item text has no windows; items of the same text are all reported; an
    empty benchmark hits nothing; a null item id is reported as "null". Repeated rows stay, each with its own result; a very long
    text is held alone, whole; an empty table gives no rows.
    """
    rest = shards(benchmark, item_col, item_text_col, shard_bytes)
    items, more = next(rest), next(rest, None)
    if more is None:
        return scanned(docs, text_col, items, window, name, [c for c in docs.columns if c != name])
    found = None
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    while items is not None:
        texts = docs.filter(F.col(text_col).isNotNull()).select(digest.alias("digest"), F.col(text_col).alias("text"))
        hits = scanned(texts, "text", items, window, "c", ["digest"]).filter(F.size("c.hits") > 0).groupBy("digest").agg(F.first("c").alias("c"))
        new = written(hits if found is None else found.unionByName(hits), "hits")
        if found is not None:
            dropped(found)
        found, items, more = new, more, next(rest, None)
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc).s.alias("s"), F.greatest(last(acc).e, x.e).alias("e"))))
    spans = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("c.hits"))), F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x.s > F.try_element_at(acc, F.lit(-1)).e), F.concat(acc, F.array(x))).otherwise(grown(acc, x)),
    )
    key, hit = free_name(docs, "_digest"), free_name(docs, "_found")
    merged_hits = found.groupBy("digest").agg(F.struct(spans.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c.items")))).alias("items")).alias(hit))
    merged_hits = written(merged_hits.withColumnRenamed("digest", key), "hits")
    few = merged_hits.count() <= BROADCAST_TEXTS
    out = scanned(docs.withColumn(key, digest), text_col, [], window, name, [*(c for c in docs.columns if c != name), key])
    out = out.join(F.broadcast(merged_hits) if few else merged_hits, key, "left")
    c = F.struct(F.col(name).n_words.alias("n_words"), F.coalesce(F.col(hit).hits, F.col(name).hits).alias("hits"), F.coalesce(F.col(hit)["items"], F.col(name)["items"]).alias("items"))
    return out.withColumn(name, c).drop(key, hit)


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], e)
        else:
            out.append({"s": s, "e": e})
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated of every document; odd rows as in contamination()."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = contamination(docs.select("doc_id", "text"), items)
    c = F.col("contamination")
    n_hit = F.aggregate(c.hits, F.lit(0).cast("long"), lambda a, x: a + (x.e - x.s).cast("long"))
    return out.select(
        "doc_id", c.n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
