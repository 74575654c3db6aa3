"""Token-id output: documents are tokenised and their ids kept in Simple-8b files, in ascending order of document id.

Documents are range-partitioned by id and sorted within partitions; each task writes files of at most FILE_IDS ids (a
document is never split) to the shared folder and reports them in rows. Those rows, written by Spark, are the manifest:
files of failed or doubled attempts are not in it, so nobody reads them.

A file: magic, then little-endian 64-bit n_docs, n_ids, n_blocks; document ids and lengths (int64 each; the lowest int64
stands for a null id); n_blocks + 1 block offsets; the words of simple8b.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import BATCH_ROWS, parts, shared_dir, small_batches, table, tokenizer_path

MAGIC = b"TOCSIN8B"
FILE_IDS = 4 << 20
#: Rows that are encoded at once: more rows have relatively fewer distinct chunks.
ROWS = 4000
#: Chunks without control characters and white space, but for a space before.
EASY = r"^ ?[^\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}]+$"
#: Distinct chunks that a worker keeps.
CACHE = 600_000
#: Chunks that the library gets as one text.
GROUP = 500
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def byte_kinds() -> np.ndarray:
    """1 for ASCII letters, 2 for digits, 3 for punctuation, 4 for white space, 5 for parts of other characters, 6 for those control
    characters that not every library takes for white space, else 0."""
    kind = np.zeros(256, np.uint8)
    for c in range(33, 127):
        kind[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3
    kind[[*range(9, 14), 32]] = 4
    kind[28:32] = 6
    kind[128:] = 5
    return kind


KIND = byte_kinds()
LETTER, DIGIT, PUNCTUATION, WHITE, OTHER, UNCLEAR = range(1, 7)
#: First bytes of characters of which some are white space: those of two bytes, and those of three.
LEAD_TWO, LEAD_THREE = 0xC2, (0xE1, 0xE2, 0xE3)


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a byte-level pre-token surely begins in texts with those ends: where white space begins, before its last character if there are more, and after it
    if that is no space; and between ASCII letters, digits and punctuation (but not after an apostrophe)."""
    n = len(data)
    kind = KIND[data]
    back = lambda x, k: np.concatenate([np.zeros(min(k, n), x.dtype), x[: n - k]]) if k < n else np.zeros(n, x.dtype)
    one, two, three, before = back(data, 1), back(data, 2), back(data, 3), back(kind, 1)
    solid = (kind < WHITE) | ((kind == OTHER) & (data > LEAD_TWO) & ~np.isin(data, LEAD_THREE))  # this character is no white space
    solid_before = (before < WHITE) | ((before == OTHER) & (two != LEAD_TWO) & ~np.isin(three, LEAD_THREE))
    solid_after = np.append(solid[1:], np.zeros(min(n, 1), bool))
    solid_after[ends[ends > 0] - 1] = False
    white, white_before = kind == WHITE, before == WHITE
    latin = (two == 0xC3) & (before == OTHER) & (one != 0x97) & (one != 0xB7)
    out = white & (solid_before | (white_before & solid_after))
    out |= solid & white_before & (one != 32)
    out |= (kind == PUNCTUATION) & ((before == LETTER) | (before == DIGIT) | latin)
    out |= (kind == DIGIT) & ((before == LETTER) | latin) | (kind == LETTER) & (before == DIGIT)
    out |= ((kind == LETTER) | (kind == DIGIT)) & (before == PUNCTUATION) & (one != 39)
    out[:1] = False
    return out


class CachedEncoder:
    """Byte-level BPE ids of whole texts, as the library gives them without its special tokens around.

    Texts are cut where a pre-token surely begins, the chunks of many texts are made distinct together, and the library is asked
    only for those that it hasn't met lately. A text with an added token in it goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: pa.Array) -> None:
        """Look up new chunks; those without line ends and outer white space go GROUP to a text, a line each."""
        easy = pc.match_substring_regex(chunks.cast(pa.string()), EASY) if self.line is not None else pa.array(np.zeros(len(chunks), bool))
        even, odd = chunks.filter(easy).to_pylist(), chunks.filter(pc.invert(easy)).to_pylist()
        ids, sizes = [self.flat], []
        for lo in range(0, len(even), GROUP):
            group = even[lo : lo + GROUP]
            got = np.array(self.library([b"\n".join(group).decode()])[0], "<u4")
            ends = np.append(np.flatnonzero(got == self.line), len(got))
            if len(ends) != len(group):
                raise ValueError("chunks and ids don't match")
            ids.append(got[got != self.line])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        for got in self.library([x.decode() for x in odd]):
            ids.append(np.array(got, "<u4"))
            sizes.append(np.array([len(got)]))
        self.known.update(zip(even + odd, range(len(self.known), len(self.known) + len(chunks))))
        self.flat = np.concatenate(ids)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of binary UTF-8 texts (null: empty), end to end, and each text's number of them."""
        texts = pc.fill_null(texts, b"")
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content.encode()).to_numpy(zero_copy_only=False)
        if whole.any():
            rows = [self.library([t.decode()])[0] if w else None for t, w in zip(texts.to_pylist(), whole)]
            rest, n = self.encode(texts.filter(pa.array(~whole)))
            sizes = np.zeros(len(texts), np.int64)
            sizes[~whole] = n
            split = iter(np.split(rest, np.cumsum(n)[:-1]))
            out = [np.array(r, "<u4") if r is not None else next(split) for r in rows]
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8)
        at = at.astype(np.int64) - at[0]
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = cuts(data, at[1:])
        first[at[:-1]] = True
        first = first[:-1]
        start = np.flatnonzero(first)
        offsets = np.append(start, len(data)).astype(np.int32)
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.forget()
        slot = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        if len(new):
            self.learn(chunks.dictionary.take(pa.array(new)))
            slot[new] = np.fromiter((self.known[distinct[i]] for i in new.tolist()), np.int64, len(new))
        slot = slot[chunks.indices.to_numpy()]
        begin = self.starts[slot]
        size = self.starts[slot + 1] - begin
        ends = np.cumsum(size)
        step = np.ones(ends[-1], np.int64)  # from one id's place to the next: one, but for a chunk's first (no chunk is without ids)
        step[0] = begin[0]
        step[ends[:-1]] = begin[1:] - begin[:-1] - size[:-1] + 1
        upto = np.append(0, ends)[np.searchsorted(start, at)]
        return self.flat[np.cumsum(step, out=step)], np.diff(upto)


ENCODERS: dict[str, CachedEncoder] = {}


def loaded(path: str) -> CachedEncoder:
    """The worker's encoder of a tokenizer file, kept from task to task with what it has cached."""
    if path not in ENCODERS:
        ENCODERS[path] = CachedEncoder(path)
    return ENCODERS[path]


def write_file(filesystem, path: str, ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> None:
    words, offsets = simple8b.encode(tokens)
    with filesystem.open_output_stream(path) as f:
        f.write(MAGIC + np.array([len(ids), len(tokens), len(offsets) - 1], "<i8").tobytes())
        f.write(ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + offsets.astype("<u8").tobytes())
        f.write(words.astype("<u8").tobytes())


def read_file(filesystem, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and all tokens of one file."""
    with filesystem.open_input_stream(path) as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{path} is no token file")
    n_docs, n_ids, n_blocks = np.frombuffer(raw, "<i8", 3, 8)
    ids, lengths = np.frombuffer(raw, "<i8", n_docs, 32), np.frombuffer(raw, "<i8", n_docs, 32 + 8 * n_docs)
    offsets = np.frombuffer(raw, "<u8", n_blocks + 1, 32 + 16 * n_docs)
    return ids, lengths, simple8b.decode(np.frombuffer(raw, "<u8", -1, 40 + 16 * n_docs + 8 * n_blocks), offsets, int(n_ids))


def write_tokens(docs: DataFrame, id_col: str, text_col: str, folder: str, tokenizer: str, end_id: int | None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs' ids under folder; returns the manifest, read back from the parquet table beside the files.

    Order: ascending id_col (null first), then the text's hash for repeated ids. Null text counts as empty: it has only
    end_id. An empty table gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").withColumn("part", F.spark_partition_id())
    end = 0 if end_id is None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        k, part, held, size = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k, held, size
            path = f"{folder}/part-{part:06d}-{k:05d}-{uuid.uuid4().hex}.s8b"
            ids, lengths, tokens = (np.concatenate(x) for x in zip(*held))
            write_file(filesystem, base + path[len(folder) :], ids, lengths, tokens)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([k], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_ids": [len(tokens)]})
            k, held, size = k + 1, [], 0
            return out

        for b in parts(batches, "text", ROWS):
            part = b.column("part")[0].as_py()
            codes, n = loaded(tokenizer).encode(b.column("text"))
            ids = pc.fill_null(b.column("id"), NO_ID).to_numpy()
            ends = np.cumsum(n)
            tokens = np.insert(codes, ends, end_id) if end else codes
            n = n + end
            ends = np.cumsum(n)
            lo = 0
            while lo < len(ids):  # as many documents as the file has room for
                before = ends[lo - 1] if lo else 0
                hi = int(np.searchsorted(ends, before + file_ids - size, side="right"))
                if hi == lo and held:
                    yield flush()
                    continue
                hi = max(hi, lo + 1)
                held.append((ids[lo:hi], n[lo:hi], tokens[before : ends[hi - 1]]))
                size += int(ends[hi - 1] - before)
                lo = hi
        if held:
            yield flush()

    folder = folder.rstrip("/")
    filesystem, base = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(base)
    small_batches(rows).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """manifest and start: the ids in all files before. Only one number per written partition passes the driver."""
    sums = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip((p for p, _ in sums), np.concatenate([[0], np.cumsum([n for _, n in sums])]).astype(int).tolist()))
    spark = manifest.sparkSession
    bases = spark.createDataFrame(sorted(base.items()), "part int, base long")
    w = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(bases, "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files (path, start): doc_id, start, n_tokens, ids (array<long>)."""
    return _read(files, "doc_id long, start long, n_tokens long, ids array<long>", lambda t: t.astype(np.int64))


def read_digests(files: DataFrame) -> DataFrame:
    """As read_documents(), with ids_crc32 of the ids as little-endian uint32 instead of the ids."""
    return _read(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda t: zlib.crc32(t.astype("<u4").tobytes()))


def _read(files: DataFrame, schema: str, of) -> DataFrame:
    name = schema.split(", ")[-1].split(" ")[0]
    kind = pa.list_(pa.int64()) if "array" in schema else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                ids, lengths, tokens = read_file(*fs.FileSystem.from_uri(path))
                ends = np.cumsum(lengths)
                for lo in range(0, len(ids), BATCH_ROWS):
                    hi = min(lo + BATCH_ROWS, len(ids))
                    last = [of(tokens[e - n : e]) for n, e in zip(lengths[lo:hi], ends[lo:hi])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[lo:hi], pa.int64(), mask=ids[lo:hi] == NO_ID), "start": pa.array(start + ends[lo:hi] - lengths[lo:hi], pa.int64()),
                        "n_tokens": pa.array(lengths[lo:hi], pa.int64()), name: pa.array(last, kind),
                    })

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(run, schema)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files; nulls and odd rows as in write_tokens()."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tocsin-tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(docs, "doc_id", "text", folder, tokenizer_path("byte_bpe_50k.json"), 2)
    return read_digests(with_starts(manifest))
