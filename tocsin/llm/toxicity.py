"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over overlapping windows.

A word's input is its own vector (words that at least two training documents have; others share one) beside the mean of
the vectors of its character trigrams. Two recurrent passes read a window, attention pools their states, and one unit gives
the window's logit. A document's score is that of its most toxic window; every window of the whole text is scored.

Labels say only which documents are toxic, so training goes from weak to strong: first all windows have their document's
label, then each document is learnt by its own most toxic window.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, remainder, table, words_alnum

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 12, 12, 6, 2048
#: The bound of the labelled sample, in documents; all their windows and words are learnt from.
TRAIN_DOCS = 3000
#: First passes over all windows: as many as see about so many windows, from one to three.
FIRST_WINDOWS = 36_000
#: Windows scored at once; texts are grouped so that a group has about so many.
CHUNK = 1024
#: The score from which a document counts as toxic; training puts the best cut between the classes there.
CUT = 0.7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_starts(n: int) -> list[int]:
    """Starts of windows that together hold all of n words; one, of nothing, for no words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Parameters p and the passes through them."""

    def __init__(self, vocabulary: dict[bytes, int], p: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, p

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], rng) -> Network:
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": draw(TRIGRAMS, CHAR_DIM, scale=0.1)}
        for side in "fb":
            p |= {f"w{side}": draw(d, 3 * h, scale=d**-0.5), f"u{side}": draw(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        p |= {"att": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        return cls(vocabulary, p)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: numbers in the vocabulary (the last row for others), trigram buckets end to end, and their ends."""
        number = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], np.int64)
        raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
        size = np.array([len(w) + 2 for w in words], np.int64)
        code = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) if len(raw) > 2 else raw[:0]
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(21)
        ends = np.cumsum(size)
        inside = np.ones(max(len(raw) - 2, 0), bool)
        for off in (1, 2):  # trigrams that run over a word's end
            at = ends[:-1] - off
            inside[at] = False
        return number, code[inside].astype(np.int64), np.cumsum(size - 2)

    def inputs(self, number: np.ndarray, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], ends[:-1]])
        mean = np.add.reduceat(self.p["char"][code], starts, axis=0) / (ends - starts)[:, None] if len(ends) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][number], mean.astype(np.float32)], axis=1)

    def pass_over(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [T, B, h] for gate inputs [T, B, 3h]; keep gets what the way back needs."""
        h, u = HIDDEN, self.p[f"u{side}"]
        steps, size = gates.shape[:2]
        state = np.zeros((size, h), np.float32)
        out = np.empty((steps, size, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = state @ u
            zr = 1 / (1 + np.exp(-(gates[t, :, : 2 * h] + g[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gates[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = np.where(mask[t][:, None], n + z * (state - n), state)
            if keep is not None:
                keep.append((t, state, z, r, n, g[:, 2 * h :]))
            state = out[t] = new
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask, states @ self.p["att"], -1e9)
        a = np.exp(e - e.max(0))
        a *= mask
        a /= np.maximum(a.sum(0), 1e-9)
        context = np.einsum("tb,tbh->bh", a, states)
        return context @ self.p["out"] + self.p["bias"][0], a, context

    def logits(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The logits of each text's windows."""
        distinct: dict[bytes, int] = {}
        ids = [np.array([distinct.setdefault(w, len(distinct) + 1) for w in words], np.int64) for words in texts]
        x = self.inputs(*self.features(list(distinct)))
        gates = {s: np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ self.p[f"w{s}"] + self.p[f"c{s}"]]) for s in "fb"}
        wins, counts = [], []
        for row in ids:
            starts = window_starts(len(row))
            counts.append(len(starts))
            padded = np.zeros(max(WINDOW, len(row)), np.int64)
            padded[: len(row)] = row
            wins.append(padded[np.array(starts)[:, None] + np.arange(WINDOW)])
        wins = np.concatenate(wins) if wins else np.zeros((0, WINDOW), np.int64)
        out = np.empty(len(wins), np.float32)
        order = np.argsort((wins != 0).sum(1), kind="stable")  # short windows together need few steps
        for lo in range(0, len(wins), CHUNK):
            at = order[lo : lo + CHUNK]
            part = wins[at].T
            part = part[: max(1, int((part != 0).sum(0).max()))]
            mask = part != 0
            states = np.concatenate([self.pass_over(s, gates[s][part], mask) for s in "fb"], axis=2)
            out[at] = self.pooled(states, mask)[0]
        return np.split(out, np.cumsum(counts)[:-1])

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """The largest logit of each text, grouped to bound memory."""
        out, group, size = [], [], 0
        for i, words in enumerate(texts):
            group.append(words)
            size += len(words)
            if size > 32 * CHUNK or i == len(texts) - 1:
                out += [x.max() for x in self.logits(group)]
                group, size = [], 0
        return np.array(out, np.float32)

    def gradients(self, windows: list[list[bytes]], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy over windows (of one window's words at most)."""
        p, h = self.p, HIDDEN
        distinct: dict[bytes, int] = {}
        part = np.zeros((WINDOW, len(windows)), np.int64)
        for b, words in enumerate(windows):
            part[: len(words), b] = [distinct.setdefault(w, len(distinct) + 1) for w in words]
        mask = part != 0
        number, code, ends = self.features(list(distinct))
        x = np.concatenate([np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), self.inputs(number, code, ends)])
        held: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.pass_over(s, (x @ p[f"w{s}"] + p[f"c{s}"])[part], mask, held[s]) for s in "fb"], axis=2)
        logit, a, context = self.pooled(states, mask)
        d_logit = ((sigmoid(logit) - labels) * weights / len(windows)).astype(np.float32)
        grad = {"out": context.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_context = d_logit[:, None] * p["out"]
        d_a = np.einsum("bh,tbh->tb", d_context, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        grad["att"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = a[:, :, None] * d_context + d_e[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        for s, d_side in (("f", d_states[:, :, :h]), ("b", d_states[:, :, h:])):
            u, d_u, d_gates, carry = p[f"u{s}"], np.zeros((h, 3 * h), np.float32), np.zeros((WINDOW, len(windows), 3 * h), np.float32), np.zeros((len(windows), h), np.float32)
            for t, state, z, r, n, g in reversed(held[s]):
                d = carry + d_side[t]
                m = mask[t][:, None]
                d_new = d * m
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z, d_r = d_new * (state - n) * z * (1 - z), d_n * g * r * (1 - r)
                d_h = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u += state.T @ d_h
                carry = d * ~m + d_new * z + d_h @ u.T
            flat = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(flat, part.ravel(), d_gates.reshape(-1, 3 * h))
            flat[0] = 0
            grad |= {f"u{s}": d_u, f"w{s}": x.T @ flat, f"c{s}": flat.sum(0)}
            d_x += flat @ p[f"w{s}"].T
        d_x = d_x[1:]
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], number, d_x[:, :WORD_DIM])
        size = np.diff(ends, prepend=0)
        np.add.at(grad["char"], code, np.repeat(d_x[:, WORD_DIM:] / size[:, None], size, axis=0))
        return grad


def train(sample: list[tuple[bytes, int]], seed: int = 0) -> tuple[Network, float]:
    """The network, and the shift of its logits that puts the best cut of the sample at CUT."""
    rng = np.random.default_rng(seed)
    docs = [words_alnum(t) for t, _ in sample]
    y = np.array([label for _, label in sample], np.float32)
    df = Counter(w for d in docs for w in set(d))
    vocabulary = {w: i for i, (w, n) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))) if n >= 2}
    net = Network.new(vocabulary, rng)
    if not len(y) or y.min() == y.max():
        return net, 0.0
    heavy = np.where(y > 0, np.minimum(8.0, (y == 0).sum() / (y > 0).sum()), 1.0).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def learn(windows: list, of: np.ndarray, rate: float) -> None:
        nonlocal step
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            at = order[lo : lo + 64]
            grad = net.gradients([windows[i] for i in at], y[of[at]], heavy[of[at]])
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    cut = [[d[s : s + WINDOW] for s in window_starts(len(d))] for d in docs]
    every = [(w, i) for i, ws in enumerate(cut) for w in ws]
    small = max(1, 3000 // max(1, len(docs)))  # few documents are seen more often
    for _ in range(max(1, min(3, 1 + small // 2, FIRST_WINDOWS // max(1, len(every))))):
        learn([w for w, _ in every], np.array([i for _, i in every]), 0.01)
    for k in range(min(16, 5 + small)):
        tops, lo = [], 0
        while lo < len(docs):
            hi = lo
            while hi < len(docs) and (hi == lo or sum(map(len, docs[lo:hi])) < 32 * CHUNK):
                hi += 16
            tops += [int(x.argmax()) for x in net.logits(docs[lo:hi])]
            lo = hi
        learn([cut[i][t] for i, t in enumerate(tops)], np.arange(len(docs)), 0.01 if k < 3 else 0.004)
    s = net.score(docs)
    order = np.argsort(-s)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    border = (s[order[best]] + s[order[min(best + 1, len(s) - 1)]]) / 2
    return net, float(np.log(CUT / (1 - CUT)) - border)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep) -> list[tuple[bytes, int]]:
    """(text, label) of at most TRAIN_DOCS labelled rows where keep holds, by the order of a hash of the id."""
    some = labels.filter(keep & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    some = some.withColumn("at", F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))).orderBy("at", "y").limit(TRAIN_DOCS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.col("text").isNotNull())
    return [(bytes(r.text), min(1, max(0, r.y))) for r in rows.join(F.broadcast(some), "id").orderBy("at", "text").limit(TRAIN_DOCS).collect()]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep=None, name: str = "toxicity") -> DataFrame:
    """docs with a struct `name`: score (0 to 1) and n_windows.

    Learns from labels where keep holds (all but crc32 of the id modulo 3 of 1, if not given). Null and wordless texts have
    one window, of nothing. Where there is nothing to learn, or one class only, scores are those of a network that hasn't
    learnt. Equal texts get equal scores; a very long text is held alone, and all its windows count; an empty table gives no rows.
    A column called `name` is replaced.
    """
    if keep is None:
        keep = F.coalesce(remainder(F.col(id_col), 3) != 1, F.lit(True))
    net, shift = train(labelled_sample(docs, labels, id_col, text_col, label_col, keep))
    shared = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.p, shift))

    def make() -> Callable:
        vocabulary, p, move = shared.value
        model = Network(vocabulary, p)

        def f(texts):
            words = [words_alnum(t) for t in texts]
            scores = sigmoid(model.score(words).astype(np.float64) + move)
            return [(float(s), len(window_starts(len(w)))) for s, w in zip(scores, words)]

        return f

    return per_row(docs, text_col, make, "score double, n_windows long", name, [c for c in docs.columns if c != name], batched=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; odd rows as in toxicity()."""
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
