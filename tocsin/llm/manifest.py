"""Merkle manifest of a dataset: a tree of each source's rows, a tree of the sources' roots above, proofs and their check.

Rows are sorted over partitions and their positions counted. A task holds a stretch of positions and keeps the mountain range
over it: for each level a stack of nodes, in base FANOUT. A node that ends its run takes the run off the stack and carries its
hash one level up; the last run of a level may be short and is hashed without padding. Runs that begin or end outside the
stretch stay, as peaks. Peaks of neighbouring stretches meet, and the same stacks carry on, until only roots are left; the way
back hands every peak the siblings above it, and at last every row its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import dropped, small_batches, table, written

FANOUT = 3
#: A stretch has up to 2**STRETCH_BITS rows of one sorted partition; up to 2**MEET_BITS neighbours meet in each step after that.
STRETCH_BITS, MEET_BITS = 13, 3
#: monotonically_increasing_id() counts a partition's rows in so many bits.
ROW_BITS = 33

PEAK = "stretch long, tree string, level int, number long, leaves long, digest string"
WAY = "array<struct<before: string, after: string>>"
PEAK_WAY = f"stretch long, tree string, level int, number long, way {WAY}"
PLACE = [("stretch", pa.int64()), ("tree", pa.string()), ("level", pa.int32()), ("number", pa.int64())]
PEAK_ARROW = pa.schema([*PLACE, ("leaves", pa.int64()), ("digest", pa.string())])
WAY_ARROW = pa.schema([*PLACE, ("way", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])

#: A way to the root: the siblings' digests before and after a node, and the way on from its parent; None at the root.
Way = tuple[tuple[str, str], "Way"] | None


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Range:
    """The mountain range over nodes of one tree that come in the order of their first leaf.

    Runs that are hashed are given to `hashed`, children first; what could not be hashed stays in peaks().
    """

    def __init__(self, leaves: int, hashed: Callable[[int, list[tuple[int, str]]], None] | None = None):
        self.hashed, self.widths = hashed, [leaves]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // FANOUT))
        self.stacks: list[list[tuple[int, str]]] = [[] for _ in self.widths]

    def push(self, level: int, number: int, digest: str) -> None:
        while True:
            stack, place = self.stacks[level], number % FANOUT
            stack.append((number, digest))
            if level == len(self.widths) - 1 or (place < FANOUT - 1 and number < self.widths[level] - 1):
                return
            run = stack[-1 - place :]
            if len(run) <= place or run[0][0] != number - place:  # it begins outside
                return
            del stack[-1 - place :]
            if self.hashed:
                self.hashed(level, run)
            level, number, digest = level + 1, number // FANOUT, h("".join(d for _, d in run))

    def peaks(self) -> Iterator[tuple[int, int, str]]:
        for level, stack in enumerate(self.stacks):
            for number, digest in stack:
                yield level, number, digest


def ranges(nodes: list[tuple], hashed: Callable | None = None) -> Iterator[tuple[str | None, int, Range]]:
    """(tree, leaves, range) over nodes (tree, level, number, leaves, digest), which lie by tree and first leaf."""
    at = None
    for tree, level, number, leaves, digest in nodes:
        if at is None or at[0] != tree:
            if at:
                yield at
            at = (tree, leaves, Range(leaves, hashed and (lambda *run, tree=tree: hashed(tree, *run))))
        at[2].push(level, number, digest)
    if at:
        yield at


def climb(nodes: list[tuple]) -> list[tuple]:
    """The peaks over nodes, as (tree, level, number, leaves, digest)."""
    return [(tree, level, number, leaves, digest) for tree, leaves, r in ranges(nodes) for level, number, digest in r.peaks()]


def descend(nodes: list[tuple], ways: dict[tuple, Way]) -> list[Way]:
    """The ways of nodes, in order, from those of the peaks that climb() makes of them, by (tree, level, number)."""
    of, runs = dict(ways), []
    for _ in ranges(nodes, lambda *run: runs.append(run)):
        pass
    for tree, level, run in reversed(runs):  # parents before children
        above, digests = of[tree, level + 1, run[0][0] // FANOUT], [d for _, d in run]
        for i, (number, _) in enumerate(run):
            of[tree, level, number] = (("".join(digests[:i]), "".join(digests[i + 1 :])), above)
    return [of[n[:3]] for n in nodes]


def steps(way: Way) -> Iterator[tuple[str, str]]:
    while way:
        yield way[0]
        way = way[1]


def folded(leaf: str, way: Way) -> str:
    """The root that a leaf leads to beside its siblings."""
    for before, after in steps(way):
        leaf = h(before + leaf + after)
    return leaf


def linked(stored: list[dict]) -> Way:
    way = None
    for x in reversed(stored):
        way = ((x["before"], x["after"]), way)
    return way


def stored(way: Way) -> list[dict]:
    return [{"before": b, "after": a} for b, a in steps(way)]


def columns(t: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*[t.column(n).to_pylist() for n in names])


def rows_as(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def in_order(t: pa.Table) -> list[tuple]:
    """(node, stretch) of peaks, by tree and first leaf."""
    nodes = list(zip(columns(t, "tree", "level", "number", "leaves", "digest"), t.column("stretch").to_pylist()))
    return sorted(nodes, key=lambda n: (n[0][0] is not None, n[0][0] or "", n[0][2] * FANOUT ** n[0][1]))


def leaf_nodes(t: pa.Table, spans: pa.Table) -> tuple[list[int], list[tuple]]:
    """A stretch's rows as nodes in the order of their ids, and where they stand in t."""
    span = {tree: rest for tree, *rest in columns(spans, "tree", "first", "before", "leaves")}
    ids, trees, digests = (t.column(c).to_pylist() for c in ("id", "tree", "digest"))
    order = sorted(range(len(ids)), key=ids.__getitem__)
    nodes = []
    for i in order:
        first, before, leaves = span[trees[i]]
        nodes.append((trees[i], 0, ids[i] - first + before, leaves, digests[i]))
    return order, nodes


def is_root(level: Column, leaves: Column) -> Column:
    """Whether a level is the one with a single node."""
    return F.pow(F.lit(float(FANOUT)), level) >= leaves


class Forest:
    """A tree for each value of `tree` over rows with `tree`, `digest` (hex text) and the columns `order` that sort them.

    Equal rows are told apart by nothing, so their order doesn't matter. No task holds more than a stretch of rows, or the peaks
    of some neighbouring stretches, of which each has a few for every level; a tree that lies whole in a stretch is done there.
    """

    def __init__(self, rows: DataFrame, order: list[str]):
        self.made: list[DataFrame] = []
        sort = ["tree", *order, "_tie"]  # equal rows, too, are dealt over partitions
        dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie")
        self.rows = self.keep(dealt.withColumn("id", F.monotonically_increasing_id()), "leaves").withColumn("stretch", F.shiftright("id", STRETCH_BITS))
        pieces = self.rows.groupBy("stretch", "tree").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("part", F.shiftright("first", ROW_BITS))
        so_far = "sum(n) OVER (PARTITION BY tree ORDER BY part ROWS UNBOUNDED PRECEDING) - n"  # a tree has a row for each partition
        parts = pieces.groupBy("part", "tree").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        parts = parts.select("part", "tree", "first", F.expr(so_far).alias("before"), F.expr("sum(n) OVER (PARTITION BY tree)").alias("leaves"))
        met = pieces.alias("p").join(parts.alias("q"), F.expr("p.part = q.part AND p.tree <=> q.tree"))
        self.spans = self.keep(met.selectExpr("p.stretch", "p.tree", "q.first", "q.before", "q.leaves"), "spans")
        last = (self.spans.agg(F.max("stretch")).first()[0] or 0) >> (ROW_BITS - STRETCH_BITS)
        self.shifts = [ROW_BITS - STRETCH_BITS + k for k in range(0, last.bit_length() + MEET_BITS, MEET_BITS)]
        self.levels = self.climbed()

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        self.made.append(written(df, what))
        return self.made[-1]

    def drop(self) -> None:
        """Delete the tables in between; what ways() and placed() give must have been stored before."""
        for df in self.made:
            dropped(df)

    def climbed(self) -> list[DataFrame]:
        """Peaks of the stretches and after each meeting; those that are roots meet no others."""

        def first(t: pa.Table, spans: pa.Table) -> pa.Table:
            at = spans.column("stretch")[0].as_py()
            return rows_as([(at, *n) for n in climb(leaf_nodes(t, spans)[1])], PEAK_ARROW)

        def meet(shift: int) -> Callable:
            def run(t: pa.Table) -> pa.Table:
                at = t.column("stretch")[0].as_py() >> shift << shift
                return rows_as([(at, *n) for n in climb([n for n, _ in in_order(t)])], PEAK_ARROW)

            return run

        leaves = small_batches(self.rows).select("stretch", "id", "tree", "digest").groupBy("stretch")
        out = [self.keep(leaves.cogroup(self.spans.groupBy("stretch")).applyInArrow(first, PEAK), "peaks")]
        for shift in self.shifts:
            open_ = out[-1].filter(~is_root(F.col("level"), F.col("leaves")))
            out.append(self.keep(open_.groupBy(F.shiftright("stretch", shift)).applyInArrow(meet(shift), PEAK), "peaks"))
        return out

    def roots(self) -> DataFrame:
        """tree and digest."""
        every = self.levels[0]
        for x in self.levels[1:]:
            every = every.unionAll(x)
        return every.filter(is_root(F.col("level"), F.col("leaves"))).select("tree", "digest")

    def ways(self, tops: DataFrame) -> DataFrame:
        """The way of each stretch's peaks; tops has tree and the way that goes on from its root."""

        def run(t: pa.Table, above: pa.Table) -> pa.Table:
            nodes = in_order(t)
            known = {tuple(k): linked(way) for *k, way in columns(above, "tree", "level", "number", "way")}
            found = descend([n for n, _ in nodes], known)
            return rows_as([(at, *n[:3], stored(way)) for (n, at), way in zip(nodes, found)], WAY_ARROW)

        fields = ["stretch", "tree", "level", "number", "way"]
        roots = [x.filter(is_root(F.col("level"), F.col("leaves"))).alias("l").join(tops.alias("t"), F.expr("l.tree <=> t.tree")).selectExpr("stretch", "l.tree", "level", "number", "way") for x in self.levels]
        ways = roots[-1]
        for peaks, here, shift in zip(reversed(self.levels[:-1]), reversed(roots[:-1]), reversed(self.shifts)):
            place = F.shiftright("stretch", shift)
            open_ = peaks.filter(~is_root(F.col("level"), F.col("leaves"))).groupBy(place)
            ways = self.keep(open_.cogroup(ways.groupBy(place)).applyInArrow(run, PEAK_WAY).unionAll(here.select(fields)), "ways")
        return ways

    def placed(self, tops: DataFrame, carry: list[str], fields: str, make: Callable[..., tuple]) -> DataFrame:
        """The columns `carry` of each row, and `fields` as make(digest, way, note, *carried) gives them; tops as in ways(), and a
        note (string) on each tree."""
        schema = T.StructType([*self.rows.select(*carry).schema, *T.StructType.fromDDL(fields)])
        arrow = to_arrow_schema(schema)

        def run(t: pa.Table, context: pa.Table) -> pa.Table:
            spans = context.filter(pc.is_valid(context.column("first")))
            peaks = context.filter(pc.is_valid(context.column("level")))
            order, nodes = leaf_nodes(t, spans)
            notes = dict(columns(spans, "tree", "note"))
            known = {tuple(k): linked(way) for *k, way in columns(peaks, "tree", "level", "number", "way")}
            kept = t.select(carry).take(pa.array(order, pa.int64()))
            rows = [make(n[4], way, notes[n[0]], *own) for n, way, own in zip(nodes, descend(nodes, known), columns(kept, *carry))]
            return pa.table([*kept.columns, *rows_as(rows, pa.schema(list(arrow)[len(carry) :])).columns], schema=arrow)

        spans = self.spans.alias("s").join(tops.alias("t"), F.expr("s.tree <=> t.tree")).selectExpr("stretch", "s.tree", "first", "before", "leaves", "note")
        context = spans.unionByName(self.ways(tops), allowMissingColumns=True)
        return small_batches(self.rows).groupBy("stretch").cogroup(context.groupBy("stretch")).applyInArrow(run, schema)


def encoded(c: Column) -> Column:
    """A value as a leaf holds it: - for null, else its UTF-8 bytes' count, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "source", presented: dict[str, Column] | None = None) -> DataFrame:
    """A row for each of docs: id_col, leaf, subroot, root, proof_sha256 (of the siblings in order), folded_root and verified.

    A leaf is the SHA-256 of the encoded `fields`. Each value of tree_col has a tree over its leaves by id_col, nulls first; rows
    with one id lie by their leaves. The trees' roots, nulls first and by their UTF-8 bytes, are the leaves of the tree above.
    presented gives columns as a reader presents them (by default as they are): folded_root is what a leaf of these and the
    original siblings lead to, verified whether that is the root.

    Null and empty values differ; a null tree_col is a tree of its own. Long texts are hashed where they are read, and only
    digests are shuffled. Equal rows get proofs of their own. An empty table gives no rows. Other columns are not read.
    """
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    leaf = lambda over: F.sha2(F.concat(*[encoded(over.get(c, col(c))) for c in fields]), 256)
    other = F.when(F.lit(False), "") if not presented else F.when(~F.greatest(F.lit(False), *[~v.eqNullSafe(col(c)) for c, v in presented.items()]), F.lit(None)).otherwise(leaf(presented))
    rows = docs.select(col(tree_col).cast("string").alias("tree"), col(id_col).alias(id_col if id_col not in ("tree", "digest", "id", "stretch", "other") else f"{id_col}_"), leaf({}).alias("digest"), other.alias("other"))
    own = rows.columns[1]
    hashed = written(rows, "digests")  # sorting samples its rows first, which else reads and hashes all texts twice
    sources = Forest(hashed, [own, "digest"])
    dropped(hashed)
    above = Forest(sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    top = above.roots().select("tree", F.lit(None).cast("string").alias("note"), F.array().cast(WAY).alias("way"))
    found = above.placed(top, ["source", "digest"], f"way {WAY}", lambda digest, way, note, *_: (stored(way),))
    root = above.roots().first()
    tops = written(found.select(F.col("source").alias("tree"), "way", F.concat("digest", F.lit(root.digest if root else "")).alias("note")), "tops")
    above.drop()

    def make(digest: str, way: Way, note: str, _, shown: str | None) -> tuple:
        subroot, root = note[:64], note[64:]
        end = folded(shown or digest, way)
        return digest, subroot, root, h("".join(b + a for b, a in steps(way))), end, end == root

    out = sources.placed(tops, [own, "other"], "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", make)
    return out.drop("other").withColumnRenamed(own, id_col)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; the text of every second one, by crc32 of
    its id, is presented without line feeds. Odd rows as in manifest()."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], presented={"text": shown})
