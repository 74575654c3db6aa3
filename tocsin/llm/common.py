"""Helpers shared by the corpus operators: tables in the shared folder, row-wise Arrow maps and word splitting."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_dir

#: Rows and bytes of text that are handled at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: The most that the session's Arrow batches may hold: executors keep several of them beside the heap.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

#: A-Z to a-z; every ASCII byte that is neither letter nor digit to a space. Bytes over 0x7F stay, so it acts on UTF-8.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Only A-Z to a-z.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_alnum(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text; none for null."""
    return text.translate(WORD_TABLE).split() if text else []


def words_space(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at just these six bytes."""
    return text.split() if text else []


RANDOM = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
#: An odd multiplier and its inverse modulo 2**64, and their powers as far as they have been needed.
BASE = 0x9FB21C651E98DF23
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Texts are hashed in parts of so many bytes, cut between words.
PART = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            POWERS[i] = np.multiply.accumulate(p)
    return POWERS[0], POWERS[1]


def byte_classes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a translation of bytes, such as WORD_TABLE: which bytes stand in words, and a random number for what each becomes."""
    to = np.frombuffer(table, np.uint8)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return ~space[to], RANDOM[to]


ALNUM, LOWER = byte_classes(WORD_TABLE), byte_classes(LOWER_TABLE)


def word_hashes(text: bytes | None, classes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """64-bit hashes of a text's words in order, the same in every process: the bytes' random numbers times powers, summed."""
    if not text:
        return np.empty(0, np.uint64)
    inside, number = classes
    b = np.frombuffer(text, np.uint8)
    word = inside[b]
    if len(b) > PART:
        gap = np.flatnonzero(~word[PART:])
        if len(gap):
            cut = PART + int(gap[0])
            return np.concatenate([word_hashes(text[:cut], classes), word_hashes(text[cut:], classes)])
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    if word[-1]:
        edge = np.concatenate([edge, [len(b)]])
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(number[b] * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows over word hashes h, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + n]
    return mix(out)


#: Paths of the tables that written() has made and dropped() has not deleted.
TABLES: set[str] = set()


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tocsin-{what}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    TABLES.add(path)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    TABLES.discard(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() once nothing reads it any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        name = path.rsplit("/", 1)[-1]
        for known in [t for t in TABLES if t.rsplit("/", 1)[-1] == name]:
            deleted(df.sparkSession, known)


def swept(spark: SparkSession, since: set[str], *kept: DataFrame) -> None:
    """Delete the tables that written() has made and that are not in `since` (a copy of TABLES), but those that kept reads: for callers
    that have stored the results of the operators they ran. Tables of other results stay."""
    names = {x.rsplit("/", 2)[-2] for df in kept for x in df.inputFiles()}
    for path in [t for t in TABLES - since if t.rsplit("/", 1)[-1] not in names]:
        deleted(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that df has no such column whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """df; the limits of its session's Arrow batches are lowered to ARROW where they are larger. They hold when df is run, so they stay."""
    conf = df.sparkSession.conf
    for name, most in ARROW.items():
        now = int(str(conf.get(name)).rstrip("b"))
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


def parts(batches: Iterator[pa.RecordBatch], text_col: str, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most so many rows and about BATCH_BYTES of text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + BATCH_BYTES, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi


def per_row(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[bytes | None], tuple]],
    fields: str,
    name: str = "_op",
    keep: list[str] | None = None,
    batched: bool = False,
) -> DataFrame:
    """df's columns (or keep of them) and one more, a struct `name` of `fields` that f = make() gives for each row's text.

    make runs once in a task; with batched, f takes and gives a list, some rows at once. The text reaches f as UTF-8 bytes; null stays None. No shuffle.
    """
    keep = df.columns if keep is None else keep
    tmp = free_name(df, "_text_bytes")
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    struct = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, struct)])
    arrow = to_arrow_schema(T.StructType([T.StructField(name, struct)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in parts(batches, tmp):
            texts = b.column(b.num_columns - 1).to_pylist()
            rows = f(texts) if batched else [f(x) for x in texts]
            if rows and isinstance(rows[0], pa.Array):  # a batch may also come as columns
                kids = rows
            else:
                cols = list(zip(*rows)) if rows else [()] * len(arrow)
                kids = [pa.array(c, arrow[i].type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.StructArray.from_arrays(kids, fields=list(arrow))], [*keep, name])

    return small_batches(df).select(*[q(c) for c in keep], q(text_col).cast("binary").alias(tmp)).mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """The place of an installed public vocabulary file; TOCSIN_TOKENIZERS overrides its folder."""
    if folder := os.environ.get("TOCSIN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col, n: int):
    """crc32 of an id written as text, modulo n: the folds that are held out."""
    return F.crc32(col.cast("string").cast("binary")) % n


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; it does so when the JVM collects them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
