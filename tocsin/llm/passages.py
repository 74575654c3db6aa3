"""Quality classifier: attention-based multiple-instance learning over the passages of a document, in numpy.

A document is a bag of passages of PASSAGE words. Each passage is encoded by hashed character trigrams and a few measures of its
make; gated attention weighs the encodings, and one unit scores their weighted sum. Labels are those of documents only, so the
attention learns by itself which passages tell. Executors make the inputs; the driver sees those of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, grams, mix, per_row, remainder, table, word_hashes

#: Words of a passage; the last of a text may have fewer.
PASSAGE = 48
BUCKETS, HIDDEN, GATE = 512, 24, 12
#: Bounds of the labelled sample: documents of each label, and passages of each, evenly spaced over the text. Scores use all passages.
CLASS_DOCS, TRAIN_PASSAGES = 1500, 24
PASSES, BAGS, RATE = 24, 32, 0.004
#: Passages encoded at once.
CHUNK = 4096
#: The score from which a document counts as good.
CUT = 0.5

SYMBOLS = b"#*$%&|<>"
KINDS = np.zeros((6, 256), np.int32)  # capitals, digits, marks, symbols, line feeds, bytes over 0x7F
KINDS[0, 65:91] = KINDS[1, 48:58] = KINDS[4, 10] = KINDS[5, 128:] = 1
KINDS[2, [c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS]] = 1
KINDS[3, list(SYMBOLS)] = 1
MEASURES = len(KINDS) + 4


def inputs(texts: list[bytes | None]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """How many passages each text has, and chunks of (trigram counts, measures) of all of them, in order.

    A text without words has one passage, of nothing. No passage's input depends on other texts.
    """
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    joined = b"\n".join(t or b"" for t in texts)
    b = np.frombuffer(joined, np.uint8)
    word = np.concatenate([[False], LOWER[0][b], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(bounds, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(start)) - (np.cumsum(n_words) - n_words)[doc]
    of = base[doc] + place // PASSAGE  # the passage of each word
    total = int(n.sum())
    size = np.bincount(of, minlength=total)
    lo, hi = np.zeros(total, np.int64), np.zeros(total, np.int64)  # bytes of each passage
    lo[of[place % PASSAGE == 0]] = start[place % PASSAGE == 0]
    np.maximum.at(hi, of, end)

    measures = np.zeros((total, MEASURES), np.float32)
    length = np.maximum(hi - lo, 1)
    for k, kind in enumerate(KINDS):
        so_far = np.concatenate([[0], np.cumsum(kind[b], dtype=np.int64)])
        measures[:, k] = (so_far[hi] - so_far[lo]) / length
    hashes = word_hashes(joined, LOWER)
    some = np.maximum(size, 1)
    measures[:, 6] = np.bincount(of, end - start, total) / some / 10
    own = mix(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    measures[:, 7] = np.bincount(of[np.unique(own, return_index=True)[1]], minlength=total) / some
    triples = grams(hashes, 3)
    whole = doc[: len(triples)] == doc[2:]  # within one text
    at = np.flatnonzero(whole)
    first = np.unique(mix(triples[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    again = np.ones(len(at), bool)
    again[first] = False
    measures[:, 8] = np.bincount(of[at[again]], minlength=total) / some
    measures[:, 9] = size / PASSAGE

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, total, CHUNK):
            z = min(a + CHUNK, total)
            many = np.maximum(hi[a:z] - lo[a:z] - 2, 0)
            ends = np.cumsum(many)
            i = np.repeat(lo[a:z] - (ends - many), many) + np.arange(int(ends[-1]))
            c = b[i].astype(np.uint32) * np.uint32(0x9E3779B1) ^ b[i + 1].astype(np.uint32) * np.uint32(0x85EBCA6B) ^ b[i + 2].astype(np.uint32) * np.uint32(0xC2B2AE35)
            c = ((c ^ (c >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            cell = np.repeat(np.arange(z - a) * BUCKETS, many) + c
            yield np.bincount(cell, minlength=(z - a) * BUCKETS).reshape(-1, BUCKETS), measures[a:z]

    return n, chunks()


class Attention:
    """Parameters p, the measures' means and spreads, and the passes through them."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray, shift: float = 0.0):
        self.p, self.mean, self.spread, self.shift = p, mean, spread, shift

    @classmethod
    def new(cls, measures: np.ndarray, rng) -> Attention:
        draw = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
        d = BUCKETS + MEASURES
        p = {"enc": draw(d, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE), "out": draw(HIDDEN), "bias": np.zeros(1, np.float32)}
        none = not len(measures)
        return cls(p, np.zeros(MEASURES, np.float32) if none else measures.mean(0), np.ones(MEASURES, np.float32) if none else measures.std(0) + 1e-3)

    def scaled(self, counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
        """Square roots of the trigrams' shares beside the standardised measures."""
        share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1), dtype=np.float32) * np.float32(8)
        return np.concatenate([share, np.clip((measures - self.mean) / self.spread, -6, 6)], axis=1, dtype=np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encodings, both gates and the attention's logits."""
        enc = np.tanh(x @ self.p["enc"] + self.p["b"])
        t, g = np.tanh(enc @ self.p["v"]), 1 / (1 + np.exp(-(enc @ self.p["u"])))
        return enc, t, g, (t * g) @ self.p["w"]

    def pool(self, enc: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of bags of n passages each, the passages' weights and the bags' vectors."""
        starts = np.cumsum(n) - n
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a /= np.repeat(np.add.reduceat(a, starts), n)
        z = np.add.reduceat(a[:, None] * enc, starts, axis=0)
        return z @ self.p["out"] + self.p["bias"][0], a, z

    def score(self, texts: list[bytes | None]) -> list[tuple[float, int, int, float]]:
        """(score, passages, the most heeded passage, its weight) of each text."""
        n, chunks = inputs(texts)
        enc, e = (np.concatenate(x) for x in zip(*((r[0], r[3]) for r in (self.encode(self.scaled(*c)) for c in chunks))))
        logit, a, _ = self.pool(enc, e, n)
        score = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) + self.shift, -30, 30)))
        out, lo = [], 0
        for s, k in zip(score, n.tolist()):
            top = int(a[lo : lo + k].argmax())
            out.append((float(s), k, top, float(a[lo + top])))
            lo += k
        return out

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy over bags of n rows of x each."""
        p = self.p
        enc, t, g, e = self.encode(x)
        logit, a, z = self.pool(enc, e, n)
        starts = np.cumsum(n) - n
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        d_z = np.repeat(d, n)[:, None] * p["out"]
        d_a = (enc * d_z).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, starts), n))
        d_tg = d_e[:, None] * p["w"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_enc = (a[:, None] * d_z + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - enc * enc)
        return {"out": z.T @ d, "bias": d.sum(keepdims=True), "w": (t * g).T @ d_e, "v": enc.T @ d_t, "u": enc.T @ d_g, "enc": x.T @ d_enc, "b": d_enc.sum(0)}


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 0) -> Attention:
    """Fitted to (counts, measures) of documents and their labels; with one label only, or none, what a new network gives."""
    rng = np.random.default_rng(seed)
    net = Attention.new(np.concatenate([m for _, m in bags]) if bags else np.zeros((0, MEASURES), np.float32), rng)
    if not len(y) or y.min() == y.max():
        return net
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    moment, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for k in range(PASSES):
        rate = RATE if k < PASSES * 2 // 3 else RATE / 4
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BAGS):
            at = order[lo : lo + BAGS]
            x = net.scaled(*(np.concatenate(c) for c in zip(*(bags[i] for i in at))))
            grad = net.gradients(x, np.array([len(bags[i][0]) for i in at]), y[at], weight[at])
            step += 1
            for name, g in grad.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[name] -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + 1e-3 * net.p[name])
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Inputs and labels of at most CLASS_DOCS documents of each label where keep holds, by the order of a hash of the id."""
    known = labels.filter(keep & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    known = known.withColumn("at", F.xxhash64(F.col("id").cast("string"), F.lit("quality")))
    some = known.filter("y = 0").orderBy("at", "id").limit(CLASS_DOCS).unionAll(known.filter("y = 1").orderBy("at", "id").limit(CLASS_DOCS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").withColumn("hash", F.xxhash64("text"))

    def make() -> Callable:
        def f(text: bytes | None) -> tuple[bytes, bytes]:
            n, chunks = inputs([text])
            pick, lo, counts, measures = np.unique(np.linspace(0, n[0] - 1, min(int(n[0]), TRAIN_PASSAGES)).round().astype(np.int64)), 0, [], []
            for c, m in chunks:
                at = pick[(pick >= lo) & (pick < lo + len(c))] - lo
                counts.append(np.minimum(c[at], 255).astype(np.uint8))
                measures.append(m[at])
                lo += len(c)
            return np.concatenate(counts).tobytes(), np.concatenate(measures).astype("<f4").tobytes()

        return f

    made = per_row(rows, "text", make, "counts binary, measures binary", "bag", ["y", "at", "id", "hash"]).dropDuplicates(["id", "y", "hash"])
    got = made.orderBy("at", "id", "y", "hash").limit(2 * CLASS_DOCS).collect()
    bags = [(np.frombuffer(bytes(r.bag.counts), np.uint8).reshape(-1, BUCKETS), np.frombuffer(bytes(r.bag.measures), "<f4").reshape(-1, MEASURES)) for r in got]
    return bags, np.array([r.y for r in got], np.float32)


def passage_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep=None, name: str = "quality") -> DataFrame:
    """docs with a struct `name`: score (0 to 1), n_passages, top_passage (the one that attention heeds most, from 0) and top_weight.

    Learns from labels where keep holds (all but crc32 of the id modulo 3 of 1, if not given); a label over 0 is good. Null and
    wordless texts have one passage, of nothing. Where there is nothing to learn, or one label only, scores are those of a network
    that hasn't learnt. Equal texts get equal scores, to six digits, whatever their ids; all passages of a very long text count, encoded CHUNK at
    a time; an empty table gives no rows. A column called `name` is replaced; others stay.
    """
    if keep is None:
        keep = F.coalesce(remainder(F.col(id_col), 3) != 1, F.lit(True))
    net = train(*sample(docs, labels, id_col, text_col, label_col, keep))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable:
        return shared.value.score

    return per_row(docs, text_col, make, "score double, n_passages long, top_passage long, top_weight double", name, [c for c in docs.columns if c != name], batched=True)


def op11_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; odd rows as in passage_quality()."""
    out = passage_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("quality.score")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
