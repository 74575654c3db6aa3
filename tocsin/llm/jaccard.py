"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, and the components of those links.

No pair is lost, and no group is compared with itself pair by pair:

1. One pass over the texts writes each row's digest, size and bitmap, and counts shingles. Rows of equal sets form one group, found by
   the digest; from here on each distinct set counts once, by a number of its own (ids may repeat).
2. Prefix filter: two sets of Jaccard at least t share one of the first n - ceil(t n) + 1 shingles in any fixed order of all
   shingles. The order is by hash, with the commonest shingles last, so passages that many documents share seldom stand in
   a prefix. Which shingles count as common only moves work; any choice gives the same links.
3. Every set is compared with the hubs (smallest numbers) of its buckets, and the links give components. Buckets of the commonest
   shingles are never dealt by the shingle alone.
4. Buckets that still hold several components are cut into tiles. In a tile, sets sorted by size are compared only within
   the size band of the threshold; hashed bitmaps bound each overlap from above by bit counts; what the bound leaves is
   intersected exactly as sorted arrays. First the best pair of any two components of a tile is tried, then, for those
   components that are still apart, all pairs.

Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, dropped, free_name, grams, mix, parts, release, small_batches, table, word_hashes, written
from .warc import join_by_group

SHINGLE = 5
#: The least Jaccard similarity, as a fraction.
THRESHOLD = (75, 100)
#: Bits of a set's bitmap: the power of two from four times its size on, within these limits.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 16
#: Rows on one side of a tile.
TILE = 1024
#: The most shingles that are ordered last; with their counts, what is sent to the tasks.
COMMON = 250_000
#: Shingles of one chunk in which tasks look for common ones.
CHUNK = 2_000_000
#: Bits of the filter that picks the rows whose sets are compared exactly: 2 MiB.
SIEVE_BITS = 1 << 24
#: A shingle that more than one of so many rows has is hot, at most the first so many of them: the choice moves work only.
HOT_SHARE, HOT_TOKENS = 1000, 20_000


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes; a text of fewer words than k, but not none, has its whole sequence as one."""
    words = word_hashes(text, LOWER)
    if not len(words):
        return words
    n = min(k, len(words))
    g = grams(words, n)
    return np.unique(g if n == k else mix(g + np.uint64(n)))


def prefix_size(n: int, t: tuple[int, int]) -> int:
    return n - -(-n * t[0] // t[1]) + 1


def bitmap(s: np.ndarray) -> bytes:
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap of so many bytes out of one as long or longer: what the same set's narrower bitmap is."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def linked(a: bytes, b: bytes, t: tuple[int, int]) -> bool:
    """Whether two sorted arrays of distinct hashes reach the threshold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(len(x) and len(y) and t[1] * both >= t[0] * (len(x) + len(y) - both))


def members(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (id, tie, text) a written table: row (a number of its own), id, tie, n, set (digest; null without words) and bits; and, with
    n null, counts c of shingles s. Tasks count chunk by chunk and forget what a chunk has once; the counts only order prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["id", "tie", "n", "set", "bits", "s", "c"]

        def counts() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            s, n = s[n >= 2], n[n >= 2]
            none = [pa.nulls(len(s), x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names)

        for b in parts(batches, "text"):
            sets = [shingles(x, k) for x in b.column("text").to_pylist()]
            n = pa.array([len(x) for x in sets], pa.int64())
            key, bits = ([f(x) if len(x) else None for x in sets] for f in (digest, bitmap))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), n, pa.array(key, pa.binary()), pa.array(bits, pa.binary()), none, none], names)
            held += sets
            size += sum(map(len, sets))
            if size > CHUNK:
                yield counts()
                held, size = [], 0
        if held:
            yield counts()

    made = small_batches(rows).select("id", "tie", "text").mapInArrow(run, "id long, tie long, n long, set binary, bits binary, s long, c long")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "members")


def common_shingles(counts: DataFrame, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to COMMON of the shingles that most rows have, sorted, their ranks, and which of them are hot."""
    top = counts.groupBy("s").agg(F.sum("c").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    s = top["s"].to_numpy(np.int64).view(np.uint64)
    hot = (top["n"].to_numpy(np.int64) * HOT_SHARE > n_rows) & (np.arange(len(s)) < HOT_TOKENS)
    order = np.argsort(s)
    return s[order], (len(s) - np.arange(len(s)))[order], hot[order]


def prefix(s: np.ndarray, t: tuple[int, int], common: np.ndarray, rank: np.ndarray, is_hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix's shingles, those that aren't hot and those that are."""
    n = prefix_size(len(s), t)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        late = common[at] == s
        if late.any():
            at = at[late]
            at = at[np.argsort(rank[at])][: max(0, n - int((~late).sum()))]
            return np.concatenate([s[~late][:n], common[at[~is_hot[at]]]]), common[at[is_hot[at]]]
    return s[:n], s[:0]


def prefixes(rows: DataFrame, k: int, t: tuple[int, int], common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """set (digest), prefix and hot (the hot shingles of the prefix) of rows that a different set can be similar enough to."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in parts(batches, "text"):
            out = []
            for text in b.column("text").to_pylist():
                s = shingles(text, k)
                if len(s) and len(s) * t[1] >= (len(s) + 1) * t[0]:  # else even a set with one shingle more is too different
                    out.append((digest(s), *(p.view(np.int64) for p in prefix(s, t, *shared.value))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), (pa.binary(), longs, longs))], ["set", "prefix", "hot"])

    return rows.select("text").mapInArrow(run, "set binary, prefix array<long>, hot array<long>")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def shared_buckets(tokens: DataFrame) -> DataFrame:
    """Of (token, id) rows those whose token another row has too, with hub, the smallest id of the token's rows, and hot, false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_token, last_id, hub, alone = None, None, None, False

        def batch(token, ids, hubs):
            return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(ids, pa.int64()), pa.array(hubs, pa.int64())], ["token", "id", "hub"])

        for b in batches:
            token, ids = b.column("token").to_numpy(), b.column("id").to_numpy()
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = token[0] != last_token
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            hubs = np.where(start >= 0, ids[np.maximum(start, 0)], hub if hub is not None else 0)
            nxt = np.append(~new[1:], False)  # the following row has the same token
            if alone and not new[0]:
                yield batch([last_token], [last_id], [last_id])
            keep = ~new | nxt
            if keep.any():
                yield batch(token[keep], ids[keep], hubs[keep])
            last_token, last_id, hub, alone = token[-1], ids[-1], hubs[-1], not keep[-1]

    return tokens.repartition("token").sortWithinPartitions("token", "id").mapInArrow(run, "token long, id long, hub long").withColumn("hot", F.lit(False))


def hot_buckets(tokens: DataFrame) -> DataFrame:
    """The same of hot tokens, with hot true: they are few, so what each has comes to its rows by broadcast."""
    hubs = tokens.groupBy("token").agg(F.min("id").alias("hub"), F.count("*").alias("of")).filter("of > 1").drop("of")
    return tokens.join(F.broadcast(hubs), "token").select("token", "id", "hub", F.lit(True).alias("hot"))


def by_token(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows (token, hot, ...) joined with groups (token, hot, ...; one row a token). Rows of hot tokens stay where they are."""
    cold = rows.filter(~F.col("hot")).join(groups.filter(~F.col("hot")).drop("hot"), "token", how)
    return cold.unionByName(rows.filter("hot").join(F.broadcast(groups.filter("hot").drop("hot")), "token", how))


def one_of_equal(shared: DataFrame) -> DataFrame:
    """shared without the tokens whose rows have the same ids as another token's: near copies share very many tokens."""
    of = shared.groupBy("token", "hot").agg(F.count("*").alias("of"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit("second"))).alias("y"), F.min("id").alias("least"))
    kept = of.groupBy("of", "x", "y", "least").agg(F.min(F.struct("token", "hot")).alias("t")).select("t.*")
    return by_token(shared, kept, "left_semi")


def sieve(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of (id, tie) of a fixed size, whatever their number: where they are too many it lets all rows through."""
    words = keys.select(F.explode(places()).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    words = words.toPandas()
    out = np.zeros(SIEVE_BITS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def places():
    return F.array(*[F.pmod(F.xxhash64("id", "tie", F.lit(i)), F.lit(SIEVE_BITS)) for i in range(3)])


def sets_of(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, items (sorted hashes) of nodes (node, id, tie): a filter of fixed size picks their rows, and few others, where they are read."""
    bits = rows.sparkSession.sparkContext.broadcast(sieve(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for b in parts(batches, "text"):
            at = b.column("at").flatten().to_numpy().reshape(-1, 3)
            some = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)
            if some.any():
                few = b.filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([few.column("id"), few.column("tie"), pa.array([shingles(x, k).tobytes() for x in few.column("text").to_pylist()], pa.binary())], ["id", "tie", "items"])

    made = rows.select("id", "tie", places().alias("at"), "text").mapInArrow(run, "id long, tie long, items binary")
    same = made.id.eqNullSafe(nodes.id) & (made.tie == nodes.tie)
    return nodes.join(made, same).select("node", "items").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) whose sets (node, items) are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(x, y, t) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").mapInArrow(run, "a long, b long").distinct()


def bounded(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) that sizes and bit counts don't rule out. Bits of a that b lacks stand for so many shingles at least."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    b = sets.select(F.col("id").alias("b"), "n", F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("m", "n", "x", "y"))):
                size = min(len(x), len(y))
                good.append(bool(possible(np.int64(m), np.int64(n), folded(x, size), folded(y, size), t)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").mapInArrow(run, "a long, b long")


def overlap(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that sets of those sizes and bitmaps (of equal width) can have in common."""
    return np.minimum(m - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), n - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def possible(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    both = overlap(m, n, x, y)
    return t[1] * both >= t[0] * (m + n - both)


def tiled_pairs(rows: DataFrame, items: DataFrame, t: tuple[int, int], best_only: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of different components within the buckets of rows (token, hot, id, component); items has
    id, n, bits. Bitmaps come to the rows once these are dealt to tiles, so they are shuffled only on the way there."""
    sizes = rows.groupBy("token", "hot").agg(F.count("*").alias("of"))
    chunks = F.ceil(F.col("of") / TILE).cast("int")
    cut = by_token(rows, sizes).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def tile(r: dict) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(r["n"], kind="stable")
        ids, comp, n, own = (r[c][order] for c in ("id", "component", "n", "own"))
        bits = [r["bits"][i] for i in order]
        width = np.array([len(x) for x in bits])
        cross = r["i"][0] != r["j"][0]
        found_a, found_b, found_bound = [], [], []
        for lo in range(0, len(ids), 128):
            hi = min(lo + 128, len(ids))
            end = np.searchsorted(n, n[hi - 1] * t[1] // t[0], side="right")  # the size band
            u, v = np.meshgrid(np.arange(lo, hi), np.arange(lo, end), indexing="ij")
            ok = (u < v) & (comp[u] != comp[v]) & (t[1] * n[u] >= t[0] * n[v])
            if cross:
                ok &= own[u] != own[v]
            u, v = u[ok], v[ok]
            for size in np.unique(width[u]):  # the smaller set has the narrower bitmap
                of = width[u] == size
                p_all, q_all = u[of], v[of]
                used = np.unique(np.concatenate([p_all, q_all]))
                maps = np.stack([folded(bits[i], size) for i in used])
                step = max(1, (1 << 24) // int(size))
                for s in range(0, len(p_all), step):
                    p, q = p_all[s : s + step], q_all[s : s + step]
                    x, y = maps[np.searchsorted(used, p)], maps[np.searchsorted(used, q)]
                    both = overlap(n[p], n[q], x, y)
                    good = t[1] * both >= t[0] * (n[p] + n[q] - both)
                    found_a.append(p[good])
                    found_b.append(q[good])
                    found_bound.append(both[good] / (n[p] + n[q] - both)[good])
        if not found_a:
            return ids[:0], ids[:0]
        p, q = np.concatenate(found_a), np.concatenate(found_b)
        if best_only and len(p):
            lo, hi = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
            order = np.lexsort((ids[q], ids[p], -np.concatenate(found_bound), hi, lo))
            first = np.ones(len(order), bool)
            first[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
            p, q = p[order[first]], q[order[first]]
        return np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            r = {c: whole.column(c).to_numpy() for c in ("token", "i", "j", "id", "component", "n", "own")}
            r["n"] = r["n"].astype(np.int64)
            bits = whole.column("bits").to_pylist()
            new = np.flatnonzero((np.diff(r["token"]) != 0) | (np.diff(r["i"]) != 0) | (np.diff(r["j"]) != 0)) + 1
            parts = [tile({"bits": bits[s:e], **{c: x[s:e] for c, x in r.items()}}) for s, e in zip([0, *new], [*new, len(r["token"])])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 1)], ["a", "b"])

        for b in batches:  # whole tiles only: the last one waits for the next batch
            if not b.num_rows:
                continue
            held.append(b)
            key = [b.column(c).to_numpy() for c in ("token", "i", "j")]
            differs = np.flatnonzero(np.any([np.diff(x) != 0 for x in key], axis=0))
            whole = pa.Table.from_batches(held)
            cut_at = len(whole) - b.num_rows + (differs[-1] + 1 if len(differs) else 0)
            if cut_at and (len(differs) or any(whole.column(c)[cut_at - 1] != whole.column(c)[cut_at] for c in ("token", "i", "j"))):
                yield from out(whole.slice(0, cut_at))
                held = whole.slice(cut_at).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    cut = cut.join(items.select("id", "n", "bits"), "id").select("token", "i", "j", "id", "component", "n", "bits", "own").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return cut.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id) for all ids of links (a, b): smallest labels spread along links, and labels' labels
    are followed, until nothing changes; each round is written, so a chain of n links takes about log n rounds."""
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = written(step.join(jump, "component", "left").select("id", F.least("component", "further").alias("component"), (F.least("component", "further") < F.col("was")).alias("moved")), "labels")
        moved = not new.filter("moved").isEmpty()
        dropped(labels)
        labels = new.drop("moved")
        if not moved:
            dropped(both)
            return labels


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, tie (a hash of the text, which tells rows of one id apart), n, component (a number of the component)
    and component_id, the smallest id in it; null where it has none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    both = members(rows, k)
    own, counts = both.filter(F.col("n").isNotNull()), both.filter(F.col("n").isNull())
    worded = own.filter(F.col("set").isNotNull())
    groups = worded.groupBy("set").agg(F.min("row").alias("row"), F.min("id").alias("least"), F.count("*").alias("n_same"))
    # nodes are numbered in the order of ids, so that hubs are the earliest documents: those that later ones are copies of
    groups = written(groups.orderBy(F.asc_nulls_last("least"), "set").withColumn("node", F.monotonically_increasing_id()), "groups")
    n_rows = groups.agg(F.sum("n_same")).first()[0] or 0
    common = common_shingles(counts, n_rows)
    sets = prefixes(rows, k, threshold, common).groupBy("set").agg(F.first("prefix").alias("prefix"), F.first("hot").alias("hot"))
    sets = written(sets.join(groups.select("set", F.col("node").alias("id")), "set").select("id", "prefix", "hot"), "prefixes")
    cold = written(shared_buckets(sets.select(F.explode("prefix").alias("token"), "id")), "buckets")
    buckets = written(cold.unionByName(hot_buckets(sets.select(F.explode("hot").alias("token"), "id"))), "buckets")
    dropped(cold)
    dropped(sets)
    release(docs.sparkSession)
    shared = written(one_of_equal(buckets), "buckets")
    dropped(buckets)
    reps = groups.select("row", "node").join(shared.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    reps = written(own.join(reps, "row").select("node", "id", "tie", "n", "bits"), "signatures")
    items = reps.select(F.col("node").alias("id"), "n", "bits")
    release(docs.sparkSession)

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = written(reps.select("node", "id", "tie").join(nodes, "node", "left_semi"), "nodes")
        sets = written(sets_of(rows, nodes, k), "sets")
        out = written(verified(pairs, sets, threshold), "verified")
        for x in (sets, nodes, pairs):
            dropped(x)
        release(docs.sparkSession)
        return out

    hubs = shared.filter("id <> hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a"))
    links = checked(bounded(hubs.select("a", "b"), items, threshold))
    labels = components(links)
    for best_only in (True, False):
        named = shared.select("token", "hot", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = named.groupBy("token", "hot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token", "hot")
        more = checked(tiled_pairs(by_token(named, open_, "left_semi"), items, threshold, best_only))
        if more.isEmpty():
            dropped(more)
            continue
        links = written(links.union(more), "verified")
        dropped(labels)
        labels = components(links)
    dropped(reps)
    dropped(shared)
    release(docs.sparkSession)
    named = groups.join(labels.withColumnRenamed("id", "node"), "node", "left").select("set", "n_same", "least", F.coalesce("component", "node").alias("component"))
    named = written(named, "labels")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.drop("least").join(least, "component"), "labels")
    some = join_by_group(worded, named, "set", "n_same", n_rows).select("id", "tie", "n", "component", "component_id")
    return some.unionByName(own.filter(F.col("set").isNull()).select("id", "tie", "n", (-1 - F.col("row")).alias("component"), F.col("id").alias("component_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links) and component, a number that tells
    components apart even where ids repeat.

    Words are what white space parts, with A-Z lower-cased. Null, empty and wordless texts have no shingles and stay alone
    with their own id. Rows that repeat a text are linked like any others; rows that repeat an id with other texts are rows of their
    own. A null id never is a component's id while it reaches another; alone, its component_id is null. An empty table gives no
    rows. A very long text is held alone, whole.
    """
    out = linked_rows(docs, id_col, text_col, k, threshold)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each component: that of the smallest id (nulls last), of repeated ids that of the smallest text hash, of rows that
    repeat both any one. No text without a similar one goes, whatever the ids; wordless rows all stay, but for such repeats."""
    one, tie = free_name(docs, "_id"), free_name(docs, "_tie")
    first = linked_rows(docs, id_col, text_col, k, threshold).groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie")).alias("f"))
    stay = first.select(F.col("f.id").alias(one), F.col("f.tie").alias(tie)).distinct()
    same = docs.withColumn(one, F.col(id_col).cast("long")).withColumn(tie, F.coalesce(F.xxhash64(text_col), F.lit(0))).dropDuplicates([one, tie])
    on = same[one].eqNullSafe(stay[one]) & (same[tie] == stay[tie])
    return same.join(stay, on, "left_semi").select(*docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; odd rows as in jaccard_components()."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("component")
