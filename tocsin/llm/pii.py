"""Personal data by bootstrapped contextual extraction.

Base spans come from fixed expressions. Besides, every whole value behind a key ("password =") or behind a cue in prose ("my
passport number is") is an instance, whatever its length and characters; and so is every other identifier-like string (letters
and digits in one run, not in a base span). Instances have the lexical patterns that they stand in: key (with and without the value's shape), words before, fixed
head ("AKIA" of a certain make), make alone. Base entities and values after known cues are seeds. Spark scores the graph of
patterns and distinct instances in rounds: a pattern is as sure as its instances on average, smoothed; an instance as its
surest patterns together. Instances that sure patterns have made sure, seeds or not, become spans of kind "id".
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, free_name, parts, per_row, small_batches, table, written
from .warc import join_by_group

KINDS = ("email", "ip", "card", "phone")
#: Of a discovered span.
FOUND = "id"
ROUNDS = 3
#: Added to a pattern's number of instances, so that one alone makes no sure pattern; from where patterns and instances count as sure.
SMOOTH, SURE_PATTERN, SURE_INSTANCE = 1.0, 0.6, 0.6
#: The same for patterns of words before, which chance makes too.
SMOOTH_LEFT = 2.0
#: Least length of an identifier without a key or a cue before it; names in the graph longer than this are digests.
SHORTEST, LONG_NAME = 8, 256
#: Keys that announce a credential or a personal number, and heads of well-known credential formats.
CUES = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "access_key", "client_secret", "ssn", "iban", "passport")
HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb", "xoxp", "sk_live_", "pk_live_")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
CORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
#: Between key and value; the value without quotes ends before the next pair of a list or a tag.
SEPARATOR = re.compile(r"[=:]+>?[ \t]*+")
QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|`([^`\n]++)`")
VALUE = re.compile(r"(?:(?![&,;?][A-Za-z_]++[=:]|</?[A-Za-z])\S)++")
#: A cue in prose, the words that may follow it, and the space before the value.
PROSE = re.compile(r"(?<![A-Za-z])(" + "|".join(c.replace("_", "[ _-]?") for c in sorted(CUES, key=len, reverse=True)) + r")((?:\s{1,3}(?:number|num|no\.?|nr\.?|code|key|id|is|was|are)(?=\s))*+)\s{1,3}(?=\S)", re.I)
HEAD = re.compile(r"[A-Z]{3,5}(?=[A-Z0-9])|[a-z]{2,3}_(?:[a-z]{4}_)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the expression finds them from the left; going out from each @, so that long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end in code points, by start and then kind."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def make_of(core: str) -> str:
    """What an identifier is made of, and how long it is."""
    if core.isdigit():
        kind = "digits"
    elif all(c in "0123456789abcdef" for c in core):
        kind = "hex"
    elif core.isupper():
        kind = "capitals"
    else:
        kind = "mixed"
    return f"{kind}{len(core)}"


def key_before(text: str, at: int) -> str:
    """The word of letters, digits and underscores before a separator at `at`, in quotes or not; it must have a letter."""
    while at > 0 and text[at - 1] in " \t":
        at -= 1
    if at > 0 and text[at - 1] in "\"'":
        at -= 1
    start = at
    while start > 0 and (text[start - 1] == "_" or text[start - 1].isascii() and text[start - 1].isalnum()):
        start -= 1
    key = text[start:at].lower()
    return key if len(key) >= 2 and any(c.isalpha() for c in key) else ""


def is_cue(key: str) -> bool:
    key = key.rstrip("0123456789_")
    return key in CUES or key.endswith(tuple(f"_{c}" for c in CUES))


def shape(value: str) -> str:
    """What a key's values must share to speak for each other."""
    if "@" in value:
        return "at"
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    return ("mixed" if letter else "digits") if digit else "words"


def shaped(pattern: str, value: str) -> str:
    return f"{pattern} ({shape(value)})"


def slot_patterns(pattern: str, value: str) -> list[str]:
    """A slot's pattern, and for a key the same for values of this shape only: base entities, whose make is their own, speak for just that."""
    return [pattern, shaped(pattern, value)] if pattern.startswith(("key ", "long ")) else [pattern] * bool(pattern)


def words_before(text: str, at: int) -> str:
    """The three words of letters before `at`, in lower case; what may stand between the last one and `at` is space and a few marks."""
    while at > 0 and (text[at - 1].isspace() or text[at - 1] in ":=#(\"'"):
        at -= 1
    words = []
    for _ in range(3):
        start = at
        while start > 0 and text[start - 1].isalpha():
            start -= 1
        if start == at:
            return ""
        words.append(text[start:at].lower())
        at = start
        while at > 0 and text[at - 1].isspace():
            at -= 1
        if at == start and len(words) < 3:
            return ""
    return " ".join(reversed(words))


def value_at(text: str, at: int) -> tuple[int, int]:
    """Start and end of the whole value: what stands in quotes, or all up to a space, without the punctuation of the sentence."""
    if m := QUOTED.match(text, at):
        return m.span(m.lastindex)
    while at < len(text) and text[at] in "\"'`":
        at += 1
    m = VALUE.match(text, at)
    return (at, at + len(m[0].rstrip(".,;:)]}>\"'`"))) if m else (at, at)


def slots(text: str) -> list[tuple[int, int, str, bool]]:
    """start, end, pattern and whether it is a seed of the values behind keys and behind cues in prose, by start; the longest of one start."""
    out = []
    for m in SEPARATOR.finditer(text):
        if key := key_before(text, m.start()):
            s, e = value_at(text, m.end())
            if s < e:
                out.append((s, e, named(f"key {key}"), is_cue(key)))
    for m in PROSE.finditer(text):
        s, e = value_at(text, m.end())
        if s < e and text[s] not in "=:":
            digit = DIGITS.search(text, s, e) is not None
            out.append((s, e, " ".join(f"cue {m[1]}{m[2]}".lower().split()), digit and (m[2] != "" or e - s >= SHORTEST)))
    best: dict[int, tuple[int, int, str, bool]] = {}
    for x in out:
        if x[0] not in best or (x[3], x[1]) > (best[x[0]][3], best[x[0]][1]):
            best[x[0]] = x
    return [best[k] for k in sorted(best)]


def node(value: str, pattern: str) -> str:
    """What stands for a slot's value in the graph: with its pattern where it is no identifier that could be known again elsewhere."""
    known = len(value) >= SHORTEST and DIGITS.search(value)
    name = f"slot {value}" if known else f"slot {pattern} {value}"
    return named(name)


def named(name: str) -> str:
    return name if len(name) <= LONG_NAME else f"long {hashlib.sha256(name.encode()).hexdigest()}"


def bare(text: str, s: int, e: int, base: list[tuple[str, int, int]]) -> bool:
    """Whether a letter or digit from s to e is outside of the base spans, given by start."""
    for _, x, y in base:
        if any(c.isalnum() for c in text[s : min(x, e)]):
            return True
        s = max(s, min(y, e))
    return any(c.isalnum() for c in text[s:e]) or not base


def overlaps(base: list[tuple[str, int, int]], b: int, s: int, e: int) -> bool:
    """Whether a base span from number b on, by start, overlaps s to e."""
    while b < len(base) and base[b][1] < e:
        if base[b][2] > s:
            return True
        b += 1
    return False


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, list[str], bool]]:
    """start, end, value, patterns and whether it is a seed: of base spans (kept out of the spans that are found), slots and identifiers."""
    out = []
    taken = slots(text)
    behind = {s: (e, pattern, seed) for s, e, pattern, seed in taken}
    for kind, s, e in base:
        if s in behind and behind[s][1].startswith(("key ", "long ")):
            out.append((-1, -1, named(f"{kind} {text[s:e]}"), [shaped(behind[s][1], text[s:e])], True))
    done, b, c, inside = 0, 0, 0, 0
    for m in DIGITS.finditer(text):
        s, e = m.span()
        if s < done:
            continue
        while s > done and text[s - 1] in CORE:
            s -= 1
        while e < len(text) and text[e] in CORE:
            e += 1
        done = e
        while b < len(base) and base[b][2] <= s:
            b += 1
        core = text[s:e].strip("-_")
        if len(core) < SHORTEST or overlaps(base, b, s, e):
            continue
        s = text.index(core, s, e)
        e = s + len(core)
        while c < len(taken) and taken[c][0] <= s:
            inside = max(inside, taken[c][1] if taken[c][3] else 0)
            c += 1
        end, slot, seed = behind.get(s, (0, "", False))
        make, head, left = make_of(core), HEAD.match(core), "" if slot.startswith(("key ", "long ")) else words_before(text, s)
        patterns = slot_patterns(slot, text[s:end]) + ([f"head {head[0]} {make}"] if head else []) + [f"make {make}"] * (len(core) >= 16)
        patterns += [f"left {left}" if len(left) <= LONG_NAME else f"left {named(left)}"] if left else []
        whole = end == e
        if whole:
            del behind[s]
        at = (s, e) if whole or inside < e else (-1, -1)  # the span of a seed's slot around it says it already
        out.append((*at, named(core), patterns, seed or core.startswith(HEADS)))
    b = last = 0
    for s, (e, pattern, seed) in behind.items():
        while b < len(base) and base[b][2] <= s:
            b += 1
        upto = b
        while upto < len(base) and base[upto][1] < e:
            upto += 1
        near = base[b:upto]
        if e > last and (not near or bare(text, s, e, near)):
            out.append((s, e, node(text[s:e], pattern), slot_patterns(pattern, text[s:e]), seed))
            last = e if seed else last
    return out


def graph(rows: DataFrame) -> DataFrame:
    """id, tie, start, end, value, patterns, seed of all instances of the rows (id, tie, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            cols: list[list] = [[], [], [], [], [], [], []]
            for i, tie, raw in zip(*(c.to_pylist() for c in b.columns)):
                text = (raw or b"").decode()
                for x in instances(text, base_spans(text)):
                    for c, v in zip(cols, (i, tie, *x)):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "tie", "start", "end", "value", "patterns", "seed"])

    return small_batches(rows).select("id", "tie", "text").mapInArrow(run, "id long, tie long, start int, end int, value string, patterns array<string>, seed boolean")


def sure_instances(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """value, n (its occurrences) of the distinct instances that the rounds make sure."""
    values = written(found.groupBy("value").agg(F.max("seed").alias("seed"), F.array_distinct(F.flatten(F.collect_set("patterns"))).alias("patterns"), F.count("*").alias("n")), "values")
    edges = written(values.select("value", F.explode("patterns").alias("pattern")), "edges")
    total = edges.count()
    scores = written(values.select("value", F.col("seed").cast("double").alias("sure")), "scores")
    smooth = F.when(F.col("pattern").startswith("left "), SMOOTH_LEFT).otherwise(SMOOTH)
    for _ in range(rounds):
        patterns = written(
            edges.join(scores, "value").groupBy("pattern").agg(F.count("*").alias("size"), F.sum("sure").alias("mass")).withColumn("weight", F.col("mass") / (F.col("size") + smooth)),
            "patterns",
        )
        doubt = join_by_group(edges, patterns, "pattern", "size", total).filter(F.col("weight") >= SURE_PATTERN)
        doubt = doubt.groupBy("value").agg(F.sum(F.log1p(-F.least("weight", F.lit(0.999)))).alias("doubt"))
        fresh = values.select("value", "seed").join(doubt, "value", "left").select("value", F.greatest(F.col("seed").cast("double"), 1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("sure"))
        new = written(fresh, "scores")
        dropped(scores)
        dropped(patterns)
        scores = new
    out = written(scores.filter(F.col("sure") >= SURE_INSTANCE).join(values, "value").select("value", "n"), "sure")
    for x in (scores, values, edges):
        dropped(x)
    return out


def found_spans(rows: DataFrame) -> DataFrame:
    """id, tie, found (array of start, end, in order) where the method finds something besides base spans."""
    found = written(graph(rows), "instances")
    sure = sure_instances(found)
    spans = found.filter("start >= 0")
    total = spans.count()
    hits = join_by_group(spans, sure, "value", "n", total)
    return hits.groupBy("id", "tie").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tie (a hash of the text, so that rows with the same id are told apart) and text as binary."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"), F.col(text_col).cast("binary").alias("text"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base and spans, arrays of (start, end, kind), by start and then kind as listed.

    Null and empty texts have none. Rows that repeat id and text have the same spans; an empty table gives no rows. A very long text is
    held alone; identifiers may have any length.
    """
    rows = keyed(docs, id_col, text_col)

    def make():
        def f(text):
            return ([{"start": s, "end": e, "kind": k} for k, s, e in base_spans((text or b"").decode())],)

        return f

    base = per_row(rows, "text", make, "spans array<struct<start:int,end:int,kind:string>>", "b", ["id", "tie"]).select("id", "tie", F.col("b.spans").alias("base"))
    a, b = base.alias("a"), found_spans(rows).alias("b")
    out = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.tie") == F.col("b.tie")), "left")
    found = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(FOUND).alias("kind")))
    order = F.array(*map(F.lit, (*KINDS, FOUND)))
    number = lambda s: F.struct(s.start.alias("start"), F.array_position(order, s.kind).alias("place"), s.end.alias("end"), s.kind.alias("kind"))
    spans = F.transform(F.array_sort(F.transform(F.concat("base", found), number)), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    return out.select(F.col("a.id").alias(id_col), "base", spans.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; overlapping spans become one, of the first's kind.

    Null text stays null; other columns, also such as clash with names used here, are left as they are.
    """
    one, tie, found = free_name(docs, "_id"), free_name(docs, "_tie"), free_name(docs, "_found")
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    spans = found_spans(keyed(docs, id_col, text_col)).select(F.col("id").alias(one), F.col("tie").alias(tie), F.col("found").alias(found))
    rows = docs.join(spans, q(id_col).cast("long").eqNullSafe(F.col(one)) & (F.coalesce(F.xxhash64(text_col), F.lit(0)) == F.col(tie)), "left").drop(one, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, text_col):
            texts = [
                t if t is None else masked(t, [*base_spans(t), *((FOUND, s["start"], s["end"]) for s in more or ())]) for t, more in zip(b.column(text_col).to_pylist(), b.column(found).to_pylist())
            ]
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, pa.string())).drop_columns([found])

    return small_batches(rows).mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"<{kind.upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base kinds, base_sha256 and all spans of every document; odd rows as in personal_data()."""
    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
