"""Embedding whitening by TSQR: exact sums, a QR of each partition's centred rows, R factors merged as a tree, and the SVD of the last R.

The right singular vectors are the covariance's eigenvectors and the squared singular values over n its eigenvalues, so no
covariance is ever formed. Entries are integers, hence sums and deviations are exact; only the centred quotient is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, free_name, small_batches, table, written

#: What an entry c becomes: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components that are returned, at most.
COMPONENTS = 8
#: R factors that meet in one step of the tree, and rows that are stacked on an R at once.
FAN, BLOCK = 16, 4096
#: Entries whose scaled value is beyond this have no exact long; they count as not finite.
LARGEST = float(1 << 62)


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: its lengths, which rows hold only finite entries, and those rows' scaled entries end to end."""
    lists = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) or column.type.value_type != pa.float64() else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()  # what null lists may hide is left out
    value = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(value * SCALE)
        good = np.abs(scaled) < LARGEST  # false for nan and the infinities
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~good)])
    ok = pc.is_valid(lists).to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    return size, ok, scaled[np.repeat(ok, size)].astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of integers, as Python ints where a long could overflow."""
    if not x.size:
        return [0] * x.shape[1]
    return (x if int(np.abs(x).max()) < (1 << 62) // len(x) else x.astype(object)).sum(0).tolist()


class Centre:
    """The exact mean S/n of the fit list; dims is the number of entries of a vector."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.dims = n, sums, len(sums)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python ints."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of a list column belong to the fit list, and n * x - S of those."""
        size, ok, flat = vectors(column)
        mine = ok & (size == self.dims)
        return mine, self.spread(flat[np.repeat(mine[ok], size[ok])].reshape(-1, self.dims))


def squares(spread: np.ndarray) -> list[int]:
    """Exact sums over each row's squares."""
    most = int(np.abs(spread).max(initial=0))
    wide = most * most * spread.shape[1] >= 1 << 63
    return ((spread.astype(object) if wide else spread) ** 2).sum(1).tolist() if spread.shape[1] else [0] * len(spread)


def centre(df: DataFrame, column: str) -> Centre | None:
    """n and the sums of the rows of the commonest length (of those the largest), or None without any row. One scan; the driver gets one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            size, ok, flat = vectors(b.column(0))
            size = size[ok]
            ends = np.cumsum(size)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                n, sums = total.get(d, (0, [0] * d))
                total[d] = (n + len(rows), [s + t for s, t in zip(sums, exact_sums(x))])
        for d, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (d + 1), pa.int64()), pa.array([-1, *range(d)], pa.int64()), pa.array([Decimal(s) for s in [n, *sums]], pa.decimal128(38))], ["dims", "dim", "total"]
            )

    parts = small_batches(df).select(column).mapInArrow(run, "dims long, dim long, total decimal(38,0)")
    sums = parts.groupBy("dims", "dim").agg(F.sum("total").alias("total"))
    first = sums.filter("dim = -1").orderBy(F.desc("total"), F.desc("dims")).limit(1)
    found = sums.join(F.broadcast(first.select("dims")), "dims").orderBy("dim").collect()
    return Centre(int(found[0].total), [int(r.total) for r in found[1:]]) if found else None


def packed(r: np.ndarray) -> bytes:
    return r.astype("<f8").tobytes()


def unpacked(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, "<f8").reshape(-1, dims)


def triangle(r: np.ndarray, more: np.ndarray) -> np.ndarray:
    """R of r with more rows below it."""
    return np.linalg.qr(np.vstack([r, more]), mode="r")


def last_factor(df: DataFrame, column: str, at: Centre) -> np.ndarray:
    """R of all centred rows: each partition's, then of FAN neighbours at a time until one is left."""
    dims = at.dims

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, some = np.zeros((0, dims)), False
        for b in batches:
            spread = at.rows(b.column(0))[1]
            for lo in range(0, len(spread), BLOCK):
                r, some = triangle(r, (spread[lo : lo + BLOCK] / at.n).astype(np.float64)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(r)], pa.binary())], ["node", "r"])

    def merge(group: pa.Table) -> pa.Table:
        node, r = group.column("node").to_pylist(), np.zeros((0, dims))
        for _, x in sorted(zip(node, group.column("r").to_pylist())):
            r = triangle(r, unpacked(x, dims))
        return pa.table({"node": pa.array([node[0] // FAN], pa.int64()), "r": pa.array([packed(r)], pa.binary())})

    leaves = written(small_batches(df).select(column).mapInArrow(leaf, "node long, r binary"), "tsqr")
    most = leaves.agg(F.max("node")).first()[0] or 0
    level = leaves
    while most:
        level = level.groupBy(F.expr(f"node div {FAN}")).applyInArrow(merge, "node long, r binary")
        most //= FAN
    r = unpacked(bytes(level.first().r), dims)
    dropped(leaves)
    return r


class Basis:
    """Components: unit vectors in rows, their eigenvalues falling, and the share of the trace that each explains."""

    def __init__(self, r: np.ndarray, n: int, most: int):
        _, s, rows = np.linalg.svd(r, full_matrices=False) if r.size else (None, np.zeros(0), r)
        rank = s > max(n, r.shape[1] if r.ndim == 2 else 0) * np.finfo(float).eps * (s[0] if len(s) else 0)
        k = min(most, r.shape[1])
        s, rows, rank = s[:k], rows[:k], rank[:k]
        side = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)]) if len(rows) else np.zeros(0)
        self.rows = rows * side[:, None]  # the largest entry is positive
        self.e = np.where(rank, s * s / n, 0.0)
        trace = float((r * r).sum()) / n
        self.explained = [float(x / trace) if trace else 0.0 for x in self.e]
        self.scale = np.where(rank, 1 / np.where(rank, np.sqrt(s * s / n), 1), 0.0)
        self.rank = rank

    def whitened(self, spread: np.ndarray, n: int) -> np.ndarray:
        return (spread / n).astype(np.float64) @ self.rows.T * self.scale


def identity_error(df: DataFrame, column: str, at: Centre, basis: Basis) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; rows are centred by the exact mean first."""
    k = int(basis.rank.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((k, k))
        for b in batches:
            w = basis.whitened(at.rows(b.column(0))[1], at.n)[:, :k]
            product += w.T @ w
        cells = np.arange(k * k, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(product.ravel())], ["cell", "v"])

    if not k:
        return 0.0
    cells = small_batches(df).select(column).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    same = F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0)
    return float(cells.agg(F.max(F.abs(F.col("v") / at.n - same))).first()[0])


def whitening(df: DataFrame, column: str = "embedding", most: int = COMPONENTS, name: str = "whitening") -> DataFrame:
    """df's rows whose vector counts, with a struct `name`: n, deviation (exact, decimal(38,0)), whitened (the values of the first
    components, null where the data have no extent), explained (their shares of the trace) and identity_error.

    Rows whose vector is null or holds null, non-finite or unrepresentable entries (1024 times it reaches 2**62) are dropped; so
    are those of another length than the commonest (of equally common ones the largest). Empty vectors, where they are the
    commonest, have no components. Repeated rows count each; a long vector is bound by one R, dims x dims doubles, in a task and on
    the driver. An empty table gives no rows. A deviation of more than 38 digits is null. A column called `name` is replaced.

    Three scans fit (sums, R factors, the error) and the result is a fourth; nothing but R factors is shuffled.
    """
    keep = [c for c in df.columns if c != name]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    fields = "n: bigint, deviation: decimal(38,0), whitened: array<double>, explained: array<double>, identity_error: double"
    alone = free_name(df, "_vector")
    only = df.select(q(column).alias(alone))
    at = centre(only, alone)
    if at is None:
        return df.select(*[q(c) for c in keep], F.lit(None).cast(f"struct<{fields}>").alias(name)).limit(0)
    basis = Basis(last_factor(only, alone, at), at.n, most)
    error = identity_error(only, alone, at, basis)
    mid = free_name(df, "_white")
    schema = df.select(*[q(c) for c in keep], F.lit(None).cast("struct<deviation: decimal(38,0), whitened: array<double>>").alias(mid)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(basis.rows)
        for b in batches:
            mine, spread = at.rows(b.column(b.num_columns - 1))
            w = basis.whitened(spread, at.n)
            total = squares(spread)
            wide = max(total, default=0) >= 1 << 63
            dev = pa.array([Decimal(x) if x < 10**38 else None for x in total], pa.decimal128(38)) if wide else pa.array(total, pa.int64()).cast(pa.decimal128(38))
            flat = pa.array(w.ravel(), mask=np.tile(~basis.rank, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), flat)
            kept = b.filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.StructArray.from_arrays([dev, lists], ["deviation", "whitened"])], [*keep, mid])

    out = small_batches(df).select(*[q(c) for c in keep], q(column).alias(alone)).mapInArrow(run, schema)
    shares = F.array(*[F.lit(x) for x in basis.explained]) if basis.explained else F.array().cast("array<double>")
    struct = F.struct(F.lit(at.n).cast("long").alias("n"), F.col(f"{mid}.deviation"), F.col(f"{mid}.whitened"), shares.alias("explained"), F.lit(error).alias("identity_error"))
    return out.select(*[q(c) for c in keep], struct.alias(name))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation (null beyond a long), whitened, explained and
    identity_error; odd rows as in whitening()."""
    out = whitening(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "whitening.*")
    each = out.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
