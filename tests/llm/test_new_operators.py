"""Passage quality, whitening and manifest against plain versions, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tocsin.llm import manifest as M
from tocsin.llm import passages as P
from tocsin.llm import whitening as W

SF = "/root/testdata/sf0.01"


# --- passages ---


def plain_inputs(text):
    """Passages of one text by loops over its words."""
    spots, at = [], 0
    text = text or b""
    for w in text.split():
        at = text.index(w, at)
        spots.append((at, at + len(w)))
        at += len(w)
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in text[a:b]) for a, b in spots]
    seen, out = set(), []
    for lo in range(0, max(1, len(spots)), P.PASSAGE):
        part = spots[lo : lo + P.PASSAGE]
        body = text[part[0][0] : part[-1][1]] if part else b""
        n = max(1, len(body))
        is_mark = lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in b"#*$%&|<>"
        kinds = [sum(65 <= c <= 90 for c in body), sum(48 <= c <= 57 for c in body), sum(map(is_mark, body)), sum(c in b"#*$%&|<>" for c in body), body.count(b"\n"), sum(c > 127 for c in body)]
        repeats = 0
        for i in range(lo, min(lo + P.PASSAGE, len(words) - 2)):
            triple = tuple(words[i : i + 3])
            repeats += triple in seen
            seen.add(triple)
        size = len(part)
        own = words[lo : lo + P.PASSAGE]
        out.append([k / n for k in kinds] + [sum(map(len, own)) / max(1, size) / 10, len(set(own)) / max(1, size), repeats / max(1, size), size / P.PASSAGE, max(0, len(body) - 2)])
    return np.array(out)


TEXTS = [None, b"", b" \n ", b"One", b"A b.\nA b c A b c 12 #*", ("Wörter für alle ".encode() * 90), b"x" * 5000, b"ab\x0bcd ef" * 70, (b"the of and THE " * 200).strip()]


def test_passage_inputs_equal_plain_ones():
    n, chunks = P.inputs(TEXTS)
    counts, measures = (np.concatenate(c) for c in zip(*chunks))
    want = [plain_inputs(t) for t in TEXTS]
    assert n.tolist() == [len(w) for w in want]
    want = np.concatenate(want)
    assert np.allclose(measures, want[:, :-1], atol=1e-6)
    assert counts.sum(1).tolist() == want[:, -1].tolist()


def test_passages_do_not_depend_on_neighbours_or_chunks(monkeypatch):
    net = P.Attention.new(np.zeros((0, P.MEASURES), np.float32), np.random.default_rng(1))
    together = net.score(TEXTS)
    monkeypatch.setattr(P, "CHUNK", 2)
    for text, got in zip(TEXTS, together):
        alone = net.score([text])[0]
        assert alone[1:3] == got[1:3] and np.allclose(alone, got, atol=1e-6)


def test_attention_equals_its_definition_and_gradients_are_differences():
    rng = np.random.default_rng(2)
    net = P.Attention.new(np.zeros((0, P.MEASURES), np.float32), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n, y, weight = np.array([1, 4, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    x = rng.standard_normal((7, P.BUCKETS + P.MEASURES)) * 0.3

    def loss():
        total, lo, p = 0.0, 0, net.p
        for k, label, w in zip(n, y, weight):
            enc = [np.tanh(row @ p["enc"] + p["b"]) for row in x[lo : lo + k]]
            e = [(np.tanh(c @ p["v"]) * (1 / (1 + np.exp(-(c @ p["u"]))))) @ p["w"] for c in enc]
            a = np.exp(e) / np.exp(e).sum()
            s = 1 / (1 + np.exp(-(sum(ai * c for ai, c in zip(a, enc)) @ p["out"] + p["bias"][0])))
            total -= w * (label * np.log(s) + (1 - label) * np.log(1 - s)) / len(n)
            lo += k
        return total

    grad = net.gradients(x, n, y, weight)
    for name, g in grad.items():
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - np.asarray(g).reshape(-1)[i]) < 1e-5, name


def test_op11_on_held_out_documents(spark):
    got = P.op11_passage_quality(spark, SF).toPandas()
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) > 0.97
    assert (held.predicted == held.quality).mean() > 0.93


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 7), (1, "good words here", 7), (None, None, 8), (3, "", 9), (4, "### $$$ " * 60_000, 1)], "doc_id int, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id int, quality int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = {(r.doc_id, r.text[:5] if r.text else r.text): r.quality for r in P.passage_quality(docs, known, keep=F.lit(True)).collect()}
        assert set(got) == {(1, "good "), (None, None), (3, ""), (4, "### $")}
        assert [got[k].n_passages for k in ((None, None), (3, ""), (4, "### $"))] == [1, 1, 2500]
        assert abs(got[None, None].score - got[3, ""].score) < 1e-6 and all(0 <= v.score <= 1 for v in got.values())
    assert P.passage_quality(docs.limit(0), labels).count() == 0
    assert P.passage_quality(docs.withColumn("at", F.lit(1)).withColumn("y", F.lit(2)), labels, name="made").columns == ["doc_id", "text", "quality", "at", "y", "made"]


# --- whitening ---


def test_op12_equals_numpy(spark):
    got = W.op12_whitening(spark, SF).toPandas()
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.floor(np.stack(e.embedding).astype(float) * 1024).astype(np.int64) + 100000
    n, total = len(x), x.sum(0)
    c = x - total / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    want = c @ vector[:, :8] / np.sqrt(value[:8])
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    assert np.allclose(mine * np.sign((mine * want).sum(0)), want, atol=1e-9)
    one = got.drop_duplicates("vec_id").set_index("vec_id").loc[e.vec_id]
    assert (one.deviation == ((n * x - total) ** 2).sum(1)).all() and (got.n == n).all()
    assert np.allclose(got.sort_values("component").drop_duplicates("component").explained, value[:8] / value.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_r_factors_merge_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 0]).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(23)
    got = W.whitening(df).collect()
    w = np.array([r.whitening.whitened[:4] for r in got], float)
    assert np.abs(w.T @ w / 300 - np.eye(4)).max() < 1e-9 and got[0].whitening.identity_error < 1e-9
    assert all(r.whitening.whitened[4] is None for r in got)  # no extent there
    assert abs(sum(got[0].whitening.explained) - 1) < 1e-12


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [1.0, None], None), (4, [nan, 1.0], "d"), (5, [1.0], "e"), (6, [3.0, 5.0], "f"), (6, [3.0, 5.0], "f"), (7, [], "x"), (8, [1e300, 1.0], "y"), (None, [2.0, 9.0], "z"), (9, [inf, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, whitening string")
    got = W.whitening(df, name="made").collect()
    assert sorted(((r.vec_id, r.whitening) for r in got), key=str) == sorted([(1, "a"), (6, "f"), (6, "f"), (None, "z")], key=str)
    x = np.array([[1, 2], [3, 5], [3, 5], [2, 9]]) * 1024 + 100000
    assert {r.vec_id: int(r.made.deviation) for r in got} == dict(zip([1, 6, 6, None], ((4 * x - x.sum(0)) ** 2).sum(1).tolist()))
    assert W.whitening(df).columns == ["vec_id", "embedding", "whitening"] and dict(W.whitening(df).dtypes)["whitening"].startswith("struct")
    assert W.whitening(df.limit(0)).count() == 0 and W.whitening(df.filter("vec_id IN (2, 4)")).count() == 0
    same = W.whitening(df.filter("vec_id = 6")).collect()
    assert [r.whitening.whitened for r in same] == [[None, None]] * 2 and same[0].whitening.deviation == 0
    far = W.whitening(spark.createDataFrame([(1, [4e15]), (2, [-4e15])], "vec_id int, embedding array<double>")).collect()
    assert {int(r.whitening.deviation) for r in far} == {(2 * 1024 * 4 * 10**15) ** 2}  # beyond a long


# --- manifest ---


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_way(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            way = plain_way(trees[s], i) + plain_way(top, k)
            shown = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[4] is None else (*r[:4], r[4].replace("\n", ""))
            end = plain_leaf(shown)
            for before, after in way:
                end = digest(before + end + after)
            out.append((r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], digest("".join(b + a for b, a in way)), end, end == top[-1][0]))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def made(df):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, M.manifest(df, FIELDS, presented={"text": shown}).collect()), key=str)


@pytest.mark.parametrize("partitions,bits", [(1, 13), (1, 3), (9, 5), (70, 4)])
def test_manifest_equals_plain_trees(spark, monkeypatch, partitions, bits):
    monkeypatch.setattr(M, "STRETCH_BITS", bits)
    monkeypatch.setattr(M, "MEET_BITS", 2)
    r = random.Random(partitions)
    rows = [(r.choice([None, *range(400)]), r.choice([None, "", "b", "é", "zz", *["big"] * 6]), r.choice(["en", None]), r.choice([None, 3]), r.choice(["", "x\ny", None, "é\n", "q" * 40])) for _ in range(700)]
    rows += [(5, "big", "en", 4, "same\n")] * 200 + [(7, "lone", None, 1, "l\n\n" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumn("digest", F.lit(1)).withColumn("tree", F.lit("x"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert made(df) == sorted(plain_manifest(rows), key=str)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars int, text string"
    assert made(spark.createDataFrame([], schema)) == []
    one = [(1, None, "en", 2, "a\n")]
    got = made(spark.createDataFrame(one, schema))
    assert got == plain_manifest(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest("")


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_ranges_cut_anywhere_meet_in_the_same_root(leaves):
    digests = [digest(str(i)) for i in range(leaves)]
    levels = plain_tree(digests)
    nodes = [("t", 0, i, leaves, d) for i, d in enumerate(digests)]
    for cut in range(leaves + 1):
        left, right = M.climb(nodes[:cut]), M.climb(nodes[cut:])
        key = lambda n: n[2] * 3 ** n[1]
        both = sorted(left + right, key=key)
        top = M.climb(both)
        assert [n[4] for n in top] == [levels[-1][0]]
        ways = dict(zip([n[:3] for n in both], M.descend(both, {top[0][:3]: None})))
        way = M.descend(nodes[:cut], ways) + M.descend(nodes[cut:], ways)
        assert [list(M.steps(w)) for w in way] == [plain_way(levels, i) for i in range(leaves)]
