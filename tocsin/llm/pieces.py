"""SentencePiece encoding and decoding by streaming Viterbi.

A lattice has the text's boundaries as nodes and pieces as edges. For each boundary one path survives and leaves a back
pointer, and a step looks back no further than the longest piece. As text streams by, all boundaries from which a piece
can still start are traced back; where their paths meet, everything before is settled and its ids are committed.

Which path survives depends on the model. A unigram model keeps the path of the best sum of scores. A BPE model (such as the
public one here) has no sums: the survivor is the path on which every two neighbouring pieces are what merging their joint
text gives. Just one edge into each boundary is so (a sequence is what BPE gives if and only if each neighbouring pair is),
so the ids are exactly the library's.

No piece of the usual vocabularies has a word mark after another character. Then all paths meet before each such mark, the
text falls into chunks that are settled on their own, and those met lately are looked up.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table, tokenizer_path

MARK = "▁"
CACHE, PAIRS = 250_000, 1_000_000
#: Boundaries between two attempts to commit.
COMMIT_EVERY = 64
UNIGRAM, BPE = 1, 2
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model: field 3 of its field 2."""

    def fields(raw: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while at < len(raw):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, raw[at : at + n]
                at += n
            else:
                n = 8 if tag & 7 == 1 else 4
                yield tag >> 3, raw[at : at + n]
                at += n

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), UNIGRAM)


class StreamingViterbi:
    """Encoder and decoder of one model."""

    def __init__(self, model: str | bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        self.kind = model_type(sp.serialized_model_proto())
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are encoded")
        self.normalize = sp.normalize
        n = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id_of = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id_of), default=1)
        tails: dict[str, set[int]] = {}
        for p in self.id_of:
            tails.setdefault(p[-2:], {1}).add(len(p))
        #: By the last two characters, the lengths that a piece may have, the longest first.
        self.lengths = {tail: sorted(of, reverse=True) for tail, of in tails.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(n))) else None
        self.unknown = sp.unk_id()
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.chunked = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.text_of = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.text_of[self.unknown] = " ⁇ ".encode()
        self.dummy = sp.normalize("a").startswith(MARK)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text: the best pair is merged, the leftmost of equals, until none can be."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether BPE leaves a and b as they are, side by side; a may be empty, before the first piece."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        of = self.pairs.get(a)
        if of is None:
            of = self.pairs[a] = {}
        got = of[b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def steps(self, text: str, first: int, last: int, piece: list[str], best: list[float], back: list[int], base: int) -> None:
        """Append for boundaries first + 1 to last of text the last piece, its path's score and where it starts; lists begin at base."""
        known, unigram = self.id_of, self.kind == UNIGRAM
        lengths, pairs, alone = self.lengths, self.pairs, (1,)
        for end in range(first + 1, last + 1):
            found, top, start = text[end - 1], float("-inf"), end - 1
            for n in lengths.get(text[end - 2 if end - 1 > base else base : end], alone):
                at = end - n
                if at < base:
                    continue
                p = text[at:end]
                if n > 1 and p not in known:
                    continue
                if unigram:
                    s = best[at - base] + self.score.get(p, self.unknown_score)
                    if s > top:
                        found, top, start = p, s, at
                    continue
                of = pairs.get(piece[at - base])
                good = of.get(p) if of is not None else None
                if good or (good is None and self.follows(piece[at - base], p)):
                    found, start = p, at
                    break
            piece.append(found)
            best.append(top)
            back.append(start)

    def stream(self, text: str) -> list[str]:
        """The pieces of a normalised text or chunk; characters without a piece stand for themselves."""
        out: list[str] = []
        piece, best, back, base = [""], [0.0], [0], 0
        for done in range(0, len(text), COMMIT_EVERY):
            end = min(done + COMMIT_EVERY, len(text))
            self.steps(text, done, end, piece, best, back, base)
            if end == len(text):
                break
            alive = set(range(max(base, end - self.longest + 1), end + 1))
            while len(alive) > 1 and max(alive) > base:
                last = max(alive)
                alive.remove(last)
                alive.add(back[last - base])
            meet = alive.pop() if len(alive) == 1 else base
            if meet > base:
                out += self.path(piece, back, base, meet)
                cut = meet - base
                piece, back, best = piece[cut:], back[cut:], [b - best[cut] for b in best[cut:]]
                base = meet
        return out + self.path(piece, back, base, len(text))

    def settle(self, chunks: list[str]) -> list[bytes]:
        """The ids of sorted chunks; each goes on from where it parts from the one before."""
        out, before, piece, best, back = [], "", [""], [0.0], [0]
        for text in chunks:
            if len(text) > 8 * COMMIT_EVERY:
                out.append(self.code(self.stream(text)))
                continue
            same, most = 0, min(len(before), len(text))
            while same < most and before[same] == text[same]:
                same += 1
            del piece[same + 1 :], best[same + 1 :], back[same + 1 :]
            self.steps(text, same, len(text), piece, best, back, 0)
            out.append(self.code(self.path(piece, back, 0, len(text))))
            before = text
        return out

    @staticmethod
    def path(piece: list[str], back: list[int], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(piece[end - base])
            end = back[end - base]
        return out[::-1]

    def code(self, pieces: list[str]) -> bytes:
        """Pieces' ids as little-endian uint32 bytes; characters without a piece as their bytes', or as one unknown id for a run."""
        out: list[int] = []
        for p in pieces:
            i = self.id_of.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian uint32 bytes."""
        texts = [self.normalize(t) for t in texts]
        if not self.chunked:
            return [self.code(self.stream(t)) for t in texts]
        heads, rest = [], []
        for text in texts:
            head = b""
            if text and text[0] != MARK:
                first = CHUNK.match(text)[0]
                head, text = self.code(self.stream(first)), text[len(first) :]
            heads.append(head)
            rest.append([c[1:] for c in CHUNK.findall(text)] if MARK * 2 in text else text[1:].split(MARK) if text else [])
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        new, old, missing = self.new, self.old, []
        for k in set().union(*rest):
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    missing.append(k)
        missing.sort()
        here = dict(new) if len(new) + len(missing) > 2 * CACHE else new  # a copy: for this batch only
        here.update(zip(missing, self.settle([MARK + k for k in missing])))
        return [head + b"".join(map(here.__getitem__, keys)) for head, keys in zip(heads, rest)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.dummy and raw.startswith(" ") else raw


def sentencepiece_ids(docs: DataFrame, text_col: str = "text", model: str | None = None, name: str = "pieces", ids: bool = True) -> DataFrame:
    """docs with a struct `name`: n_tokens, ids_crc32 (of the ids as little-endian uint32), restored (whether decoding gives
    the normalised text again) and, if wanted, ids.

    Null and empty texts have no ids and are restored. Every row stands alone; repeated rows have equal results. A very long text is held
    alone and coded whole; an empty table gives no rows. A column called `name` is replaced.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")

    def make() -> Callable:
        coder = loaded(model)

        def f(texts):
            texts = [(t or b"").decode() for t in texts]
            codes = coder.encode(texts)
            tokens = [np.frombuffer(c, "<u4") for c in codes]
            restored = [coder.decode(t.tolist()) == plain(coder, x) for t, x in zip(tokens, texts)]
            cols = [pa.array([len(t) for t in tokens], pa.int64()), pa.array([zlib.crc32(c) for c in codes], pa.int64()), pa.array(restored, pa.bool_())]
            if ids:
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4")), type=pa.list_(pa.field("element", pa.int32()))))
            return cols

        return f

    fields = "n_tokens long, ids_crc32 long, restored boolean" + ", ids array<int>" * ids
    return per_row(docs, text_col, make, fields, name, [c for c in docs.columns if c != name], batched=True)


CODERS: dict[str, StreamingViterbi] = {}


def loaded(model: str) -> StreamingViterbi:
    """The worker's coder of a model file, kept from task to task."""
    if model not in CODERS:
        CODERS[model] = StreamingViterbi(model)
    return CODERS[model]


def plain(coder: StreamingViterbi, text: str) -> str:
    """What a text is after normalisation, with word marks as spaces."""
    text = coder.normalize(text).replace(MARK, " ")
    return text[1:] if coder.dummy and text.startswith(" ") else text


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, restored and ids of every document; odd rows as in sentencepiece_ids()."""
    out = sentencepiece_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("pieces.n_tokens").alias("n_tokens"), F.col("pieces.ids_crc32").alias("ids_crc32"), F.col("pieces.restored").alias("restored"), F.col("pieces.ids").alias("ids"))
