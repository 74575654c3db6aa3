"""Language ID by string kernels: blended-spectrum n-gram presence kernels, Nyström landmarks, one-versus-rest kernel ridge.

A text is the set of its byte n-grams of 2 to 4 (hashed into BINS bits, over the whole text); the kernel of two texts is
the number of common n-grams over the geometric mean of their numbers. Labelled texts of a bounded sample give the
landmarks and fit the ridge. Texts are scored by matrix products a batch: presence rows times landmarks times weights, of which
the last two factors are the same for all texts and multiplied once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, parts, per_row, remainder, small_batches, table, written

BINS = 1 << 17
ORDERS = (2, 3, 4)
LANDMARKS = 160
#: The bound of the labelled sample: so many rows a language, fewer where all languages together would have over SAMPLE_ROWS. A row takes
#: up at most BINS numbers, however long its text.
ROWS_PER_LANGUAGE, SAMPLE_ROWS = 400, 8000
RIDGE = 1e-2


def bins(text: str, mark: np.ndarray) -> np.ndarray:
    """The sorted distinct bins of the text's n-grams; mark is BINS zeros to work with."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    h = b
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(257) + b[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            mark[(h * np.uint32(2654435761)) >> np.uint32(33 - BINS.bit_length())] = True
    out = np.flatnonzero(mark)
    mark[out] = False
    return out.astype(np.int32)


def products(rows: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Presence rows, given by their bins, times a matrix of BINS rows."""
    out = np.empty((len(rows), matrix.shape[1]), np.float32)
    for i, x in enumerate(rows):
        out[i] = matrix[x].sum(0)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class KernelClassifier:
    """Languages and, for each, the sum of the landmarks' presence rows over the roots of their sizes, by ridge weights."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, marks: list[int] | None = None) -> KernelClassifier:
        """Of rows of bins. Landmarks are taken in turn from the languages (out of the rows numbered marks), so a rare one has its share."""
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros((BINS, 0), np.float32))
        turn, seen = [], dict.fromkeys(languages, 0)
        for i in range(len(rows)) if marks is None else marks:
            turn.append((seen[labels[i]], i))
            seen[labels[i]] += 1
        some = [rows[i] for _, i in sorted(turn)[: max(landmarks, len(languages))]]
        table = np.zeros((BINS, len(some)), np.float32)  # the landmarks over the roots of their sizes, as columns
        for j, x in enumerate(some):
            table[x, j] = len(x) ** -0.5
        root_size = lambda of: np.sqrt([len(x) for x in of])[:, None]
        k = products(rows, table).astype(np.float64) / root_size(rows)
        y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
        value, vector = np.linalg.eigh(products(some, table).astype(np.float64) / root_size(some))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        phi = k @ root
        beta = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
        return cls(languages, table @ (root @ beta).astype(np.float32))

    def predict(self, rows: list[np.ndarray]) -> list[tuple[str, float]]:
        """The language and its score: half of one more than the ridge's value, between 0 and 1."""
        if not rows:
            return []
        s = products(rows, self.matrix) / np.sqrt([len(x) for x in rows])[:, None]
        best = s.argmax(1)
        top = np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1)
        return [(self.languages[b], float(p)) for b, p in zip(best, top)]


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train) -> tuple[list[np.ndarray], list[str], list[int]]:
    """Bins and languages of at most ROWS_PER_LANGUAGE rows a language where train holds, spread over all rows by a hash of id and text,
    each whole and as a short cut; and which are whole. Tasks make the bins; the texts stay there."""
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.filter(train & col(lang_col).isNotNull()).select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang")).filter(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n = counts.count()
    if not n:
        return [], [], []
    most = max(1, min(ROWS_PER_LANGUAGE, SAMPLE_ROWS // n))
    point = F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy("at")

    def lowest(langs: list[str], times: float) -> DataFrame:
        """Of each language the rows with the lowest points, `most` at most, out of those under a bound that about times * most rows of it are
        under. Rows that repeat id and text share a point and count once."""
        near = rows.join(F.broadcast(counts), "lang").filter(F.col("lang").isin(langs)).withColumn("at", point).filter(F.col("at") < times * most / F.col("n"))
        return near.groupBy("lang", "at").agg(F.min("text").alias("text")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("lang", "at", "text")

    size = {r.lang: r.n for r in counts.collect()}  # a row a language
    found, open_, times = [], sorted(size), 2.0
    while open_:  # copies, or chance, may leave a language short: then the bound is raised until it has all points
        some = written(lowest(open_, times), "sample")
        got = dict(some.groupBy("lang").count().collect())
        done = [x for x in open_ if got.get(x, 0) >= most or times * most >= size[x]]
        found.append(some.filter(F.col("lang").isin(done)))
        open_, times = [x for x in open_ if x not in done], times * 8
    some = reduce(DataFrame.unionByName, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(BINS, bool)
        for b in parts(batches, "text", 100):
            out = []
            for lang, at, text in zip(*(b.column(c).to_pylist() for c in ("lang", "at", "text"))):
                rng = np.random.default_rng(int(at * (1 << 30)))
                n = int(rng.integers(8, 80))
                s = int(rng.integers(0, max(1, len(text) - n)))
                out.append((at, lang, True, bins(text, mark)))
                if has_letter(text[s : s + n]):
                    out.append((at, lang, False, bins(text[s : s + n], mark)))
            kinds = (pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["at", "lang", "whole", "bins"])

    got = small_batches(some).select("lang", "at", "text").mapInArrow(run, "at double, lang string, whole boolean, bins array<int>").toPandas()
    got["first"] = got["bins"].map(lambda x: int(x[0]) * BINS + len(x))
    for part in found:
        dropped(part)
    got = got.sort_values(["lang", "at", "whole", "first"], kind="stable")
    return [np.asarray(x) for x in got["bins"]], got["lang"].tolist(), np.flatnonzero(got["whole"].to_numpy(bool)).tolist()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train=None, name: str = "language") -> DataFrame:
    """docs with a struct `name`: lang, score.

    Learns from rows where train holds (all but every fourth by crc32 of the id, if not given) and lang_col isn't null. A
    text that is null or has no letter is und, with score 0; so is every text where nothing can be learnt. Equal texts get
    equal results; a very long text is held alone, whole; an empty table gives no rows. A column called `name` is replaced.
    """
    if train is None:
        train = F.coalesce(remainder(F.col(id_col), 4) != 2, F.lit(True))
    rows, labels, marks = labelled_sample(docs, id_col, text_col, lang_col, train)
    model = KernelClassifier.fit(rows, labels, marks=marks)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix))

    def make():
        model = KernelClassifier(*shared.value)
        mark = np.zeros(BINS, bool)

        def f(texts):
            out = [("und", 0.0)] * len(texts)
            some = [(i, bins(t, mark)) for i, x in enumerate(texts) if x and model.languages and has_letter(t := x.decode())]
            for (i, _), p in zip(some, model.predict([r for _, r in some])):
                out[i] = p
            return out

        return f

    return per_row(docs, text_col, make, "lang string, score double", name, [c for c in docs.columns if c != name], batched=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; odd rows as in identify()."""
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
