"""The corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.llm import decontaminate, jaccard, language, licenses, pieces, pii, quality, simple8b, token_store, toxicity, warc
from tocsin.llm.common import LOWER, WORD_TABLE, byte_classes, free_name, remainder, tokenizer_path, word_hashes, written

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20000 + "x" * 60000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (5, LONG), (6, "é 日本語 🎉\x00 <b>&amp;"), (None, "no id here at all"), (None, None), (7, "...!!!")]


def frame(spark, rows):
    """documents with clashing and odd columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, _op string, id string"
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", None, 9, None, "x", "y") for i, t in rows], schema)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def test_word_hashes_tell_words_apart():
    def words(text, table):
        return text.translate(table).split()

    r = random.Random(1)
    for _ in range(50):
        t = "".join(r.choice("ab A\nB.é9") for _ in range(300)).encode()
        for table, classes in ((WORD_TABLE, byte_classes(WORD_TABLE)),):
            w, h = words(t, table), word_hashes(t, classes)
            assert len(w) == len(h) and len(set(w)) == len(set(h.tolist())) == len(set(zip(w, h.tolist())))
    big = (b"word " * 300_000) + b"y" * 1_200_000 + b" end"
    h = word_hashes(big, LOWER)
    assert len(h) == 300_002 and h[0] == h[299_999] == word_hashes(b"WORD", LOWER)[0] and h[-1] == word_hashes(b"end", LOWER)[0]


# 1 SentencePiece


def test_pieces_equal_the_library():
    model = tokenizer_path("piece_bpe_32k.model")
    ours, sp = pieces.StreamingViterbi(model), sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(0)
    cases = ["", " ", "  a  b\n\tc ▁ d", "a" * 700, "日本語テキスト🎉\x00", "\n" * 40 + " " * 50, LONG[:5000], "x" * 3000]
    cases += ["".join(r.choice("abcdehinorst ABC.,\n0123é日▁") for _ in range(r.randint(1, 500))) for _ in range(300)]
    for text, code in zip(cases, ours.encode(cases)):
        ids = np.frombuffer(code, "<u4").tolist()
        assert ids == sp.encode(text)
        assert ours.decode(ids) == sp.decode(ids) == pieces.plain(ours, text)


def test_whole_texts_stream_like_chunks():
    ours = pieces.StreamingViterbi(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(2)
    for _ in range(30):
        text = ours.normalize("".join(r.choice("thean ing,.") for _ in range(600)))
        whole = ours.code(ours.stream(text))
        ours.chunked = True
        assert whole == ours.encode([text[1:].replace("▁", " ")])[0]


def test_unigram_keeps_the_best_sum():
    ours = pieces.StreamingViterbi(tokenizer_path("piece_bpe_32k.model"))
    ours.kind = pieces.UNIGRAM
    r = random.Random(3)
    for _ in range(40):
        text = "▁" + "".join(r.choice("theaning") for _ in range(r.randint(1, 150)))
        best = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - ours.longest), e):
                p = text[s:e]
                if p in ours.score or e - s == 1:
                    best[e] = max(best[e], best[s] + ours.score.get(p, ours.unknown_score))
        got = ours.stream(text)
        assert "".join(got) == text and sum(ours.score.get(p, ours.unknown_score) for p in got) == pytest.approx(best[-1])


# 2 token ids


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 6000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 33, 1 << 63])
def test_simple8b_round_trip(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    words, offsets = simple8b.encode(x)
    assert (simple8b.decode(words, offsets, n) == x).all() and len(offsets) == -(-n // simple8b.BLOCK) + 1


def test_simple8b_packs_many_small_ids_and_escapes():
    assert len(simple8b.encode(np.ones(6000, np.uint64))[0]) <= 6 * 18
    x = np.array([1, 1 << 62, (1 << 64) - 1, 3] * 700, np.uint64)
    words, offsets = simple8b.encode(x)
    assert (simple8b.decode(words, offsets, len(x)) == x).all()


def test_token_files_hold_all_documents_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [*[r for r in ODD if r[0] != 5], (5, LONG[:9000]), (9, "a  b \n c   d\n\n e"), (10, " lead"), (11, "trail  "), (12, "a<|endoftext|>b"), (13, "<|endoftext|>")]
    manifest = token_store.write_tokens(frame(spark, rows), "doc_id", "text", f"file://{tmp_path}/t", path, 2, file_ids=500)
    got = token_store.read_documents(token_store.with_starts(manifest)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows if i is None), key=str) + sorted(i for i, _ in rows if i is not None)
    at = 0
    want = {(i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in rows}
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and (r.doc_id, tuple(r.ids)) in want
        at += r.n_tokens
    digests = token_store.read_digests(token_store.with_starts(manifest)).orderBy("start").collect()
    assert [d.ids_crc32 for d in digests] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got]
    assert manifest.count() > 1


def test_chunks_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    ours, library = token_store.CachedEncoder(path), Tokenizer.from_file(path)
    r = random.Random(12)
    alphabet = [*"abT's 1.,-\n\t\"é×", " ", " ", "the", "\u00a0", "\u3000", "\u0085", "\u200a", "\x1c", "日本", "\u0301", "🎉", "'ll", "café", " <|endoftext|>"]
    cases = ["", " ", "  ", "a", *("".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(4000)), LONG[:50_000]]
    for lo in range(0, len(cases), 500):
        some = cases[lo : lo + 500]
        ids, n = ours.encode(pa.array([x.encode() for x in some], pa.binary()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(x, add_special_tokens=False).ids for x in some]
    assert ours.encode(pa.array([None, None], pa.binary()))[1].tolist() == [0, 0] and len(ours.encode(pa.array([], pa.binary()))[1]) == 0


# 3 decontamination


def brute_contamination(text, items, window=10):
    word = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = word(text), set(), set()
    for i, t in items:
        p = word(t)
        m = min(window, len(p))
        for s in range(len(p) - m + 1 if m else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == p[s : s + m]:
                    hit |= set(range(k, k + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, shard_bytes):
    r = random.Random(4)
    say = lambda n: " ".join(r.choice("ab cd ef gh".split()) for _ in range(n))
    items = [(1, say(12)), (2, say(3)), (3, "ab"), (4, None), (5, ""), (6, say(10)), (12, say(12))]
    rows = [(100 + i, say(r.randint(0, 60)) + r.choice(["", " " + items[0][1].upper(), ", " + items[6][1]])) for i in range(25)] + ODD
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.contamination(frame(spark, rows), b, shard_bytes=shard_bytes).select("text", "contamination").collect():
        c = r.contamination
        assert (c.n_words, sum(h.e - h.s for h in c.hits), c["items"]) == brute_contamination(r.text, items)
        assert all(a.e < b.s for a, b in zip(c.hits, c.hits[1:]))


# 4 quality


def test_quality_equals_brute_force(documents):
    for text in [*list(texts(documents).values())[:60], None, "", "a b c d e a b c d e a b c d e", "x\nx\n\n\nx"]:
        n, chars, symbols, dup, repeat, failed, *_ = quality.judge(text.encode() if text is not None else None, quality.LineRules())
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 4000 else None
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (n, chars, symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert dup == len(lines) - len(set(lines))
        if twice is not None:
            assert repeat == len(twice) and failed == (n < 10 or 100 * len(twice) > 20 * n)


def test_lines_of_menus_and_notices_fail_in_four_languages():
    rules, fault = quality.LineRules(), quality.line_fault
    for line in ("Home · About · News · Contact · Help.", "Start » Produkte » Kontakt.", "Home • Blog • Login.", "one / two / three / four.", "A – B – C."):
        assert fault(line.encode(), line.encode().split(), rules) == "navigation", line
    for line in ("Alle Rechte vorbehalten.", "Lire la suite.", "Política de privacidad.", "Click here."):
        assert fault(line.encode(), line.encode().split(), rules) == "boilerplate", line
    for line in ("It was late - too late - for the two of them to go home.", "- Ja, sagte sie.", "The ratio 3 / 4 is less than one.", "Elle est arrivée hier soir."):
        assert fault(line.encode(), line.encode().split(), rules) == "", line


def test_phrases_count_as_whole_words_and_by_their_share():
    rules, fault = quality.LineRules(), quality.line_fault
    for line in (
        "The old catalog in the town library was burnt in the war.", "A design update was sent to all of them that week.", "She spread more butter on the bread.",
        "Das Impressum der Zeitung wurde 1920 geändert und danach nie wieder.", "We went home and read more of the long letters that he had sent to her from the front.", "I need help at home, she said.",
    ):
        assert fault(line.encode(), line.encode().split(), rules) == "", line
    for line, want in (("Home About News Contact Help Login Cart.", "navigation"), ("© 2020 Acme Inc. All Rights Reserved.", "boilerplate"), ("Terms of Use | Privacy Policy.", "boilerplate"), ("Conditions d'utilisation.", "boilerplate")):
        assert fault(line.encode(), line.encode().split(), rules) == want, line


def test_quality_keeps_clean_and_rejects_junk():
    clean = "The cat sat on the mat and looked at the moon. It was a fine night for all.\n" * 1 + "Another sentence stands here, quite unlike the first one."
    junk = "HOME | ABOUT | NEWS | SHOP\nBUY NOW!! CHEAP!! CLICK HERE!! FAST!!\n*** $$$ ### offer ***\nThis line is fine and is the only one here."
    rules = quality.LineRules()
    assert quality.judge(clean.encode(), rules)[6] and not quality.judge(junk.encode(), rules)[6]
    assert quality.judge(junk.encode(), rules)[8] == "This line is fine and is the only one here."


def test_quality_agrees_with_labels(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.line_first(d, text=False, name="q").join(lab, "doc_id").filter("not q.base_failed").groupBy("q.kept", "quality").count().collect()
    right = sum(x["count"] for x in r if x[0] == (x[1] == 1))
    assert right >= 0.95 * sum(x["count"] for x in r)


# 5 toxicity


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(1)
    net = toxicity.Network.new({b"a": 0, b"bb": 1}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    wins, y, w = [[b"a", b"bb", b"zz"], [b"bb"], [b"q", b"a", b"a", b"ccc"]], np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        s = toxicity.sigmoid(np.array([net.logits([x])[0][0] for x in wins], np.float64))
        return (w * -(y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    grad = net.gradients(wins, y, w)
    for k, v in net.p.items():
        i = np.unravel_index(int(np.abs(grad[k]).argmax()), v.shape)
        old, h = v[i], 1e-3
        v[i] = old + h
        up = loss()
        v[i] = old - h
        slope = (up - loss()) / (2 * h)
        v[i] = old
        assert grad[k][i] == pytest.approx(slope, rel=0.05, abs=2e-4), k


def test_toxicity_on_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.toxicity(d, lab).join(lab, "doc_id").filter(remainder(F.col("doc_id"), 3) == 1).select("toxicity.score", "toxic").collect()
    pos, neg = [x.score for x in r if x.toxic], [x.score for x in r if not x.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8 and np.mean([n >= toxicity.CUT for n in neg]) < 0.05


def test_windows_hold_every_word():
    for n in (0, 1, 48, 49, 80, 81, 500):
        starts = toxicity.window_starts(n)
        assert set(range(n)) <= {s + i for s in starts for i in range(toxicity.WINDOW)}


# 6 Jaccard


def brute_components(rows, t=(75, 100)):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and t[1] * k >= t[0] * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(vocab) for _ in range(60))
    rows, i = [], 0
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(3, 160))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            base = w if r.random() < 0.4 else base
            rows.append((i, " ".join(w) + (" " + common if g % 3 == 0 else "")))
            i += 1
    rows += [(i + k, rows[3][1].upper()) for k in range(20)] + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three four five")]
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_repeated_ids_with_other_texts_stay_apart(spark):
    a, b = "one two three four five six seven eight", "the other text has quite different words in it"
    rows = [(1, a), (1, b), (2, b), (3, a), (1 << 62, a + " nine"), (None, b), (None, "alone here with no id at all"), (9, None), (9, None), (8, "")]
    got = jaccard.jaccard_components(frame(spark, rows)).select("doc_id", "component_id", "component").collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), (str(1 << 62), "1"), ("None", "1"), ("None", "None"), ("9", "9"), ("9", "9"), ("8", "8")])
    assert len({r.component for r in got}) == 6
    kept = jaccard.deduplicated(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in jaccard.deduplicated(frame(spark, rows)).select("doc_id", "text").collect()]))
    assert {(r.doc_id, r.text) for r in kept} == {(1, a), (1, b), (None, "alone here with no id at all"), (9, None), (8, "")} and len(kept) == 5


def test_hot_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_SHARE", 10**6)  # all common shingles are hot
    monkeypatch.setattr(jaccard, "TILE", 4)
    r = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{common} " + " ".join(f"w{r.randint(0, 3)}" for _ in range(r.randint(0, 9)))) for i in range(80)] + corpus()[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_odd_rows_are_components_of_their_own(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, ODD)).collect()), key=str)
    want = {i: n for i, n in ((1, 0), (2, 0), (3, 0), (4, 1), (6, 1), (7, 1))}
    assert {(i, n, c) for i, n, c in got if i in want} == {(i, n, i) for i, n in want.items()} and len(got) == len(ODD)
    assert [c for i, n, c in got if i is None] == [None, None]


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64)]))
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        size = min(len(a), len(b))
        ok = jaccard.possible(len(x), len(y), jaccard.folded(a, size), jaccard.folded(b, size), (75, 100))
        assert ok or not jaccard.linked(x.tobytes(), y.tobytes(), (75, 100))


# 7 licenses


def test_license_base_equals_brute_force(spark):
    rows = [(11, "Released under the MIT License. mit-license, MIT licensed"), (12, "Licensed under the Apache License, Version 2.0."), (13, "cc by cc by"), (14, "This program is free software: you can redistribute it and / or modify it under the terms of the GNU General Public License"), *ODD]
    got = licenses.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[11].n_base, by[11].first_word, by[11].last_word, by[11].base_labels) == (2, 3, 5, ["mit"])
    assert (by[13].n_base, by[13].first_word, by[13].last_word, by[13].labels) == (2, 0, 2, ["cc-by"])
    assert by[12].base_labels == ["apache"] and by[12].labels == ["apache", "apache-2.0"] and by[12].score == 1.0
    assert by[14].labels == ["gpl"] and by[5].n_base == 0 and by[5].score == 0.0 and by[11].spans


def test_texts_without_a_license_have_no_label(spark):
    plain = ["a film released under the banner of a studio", "this project is licensed under new terms of the city", "the work is licensed under a new name", "licensed under the sea", "the mozilla team met the public", "Permission to use the hall was granted by the owner, and copies of the notice appear in all rooms",
             "this software is free and was made available under pressure", "redistribution of wealth, with or without modification"]
    got = licenses.scan(frame(spark, list(enumerate(plain)))).collect()
    assert [r.labels for r in got] == [[]] * len(plain) and {r.score for r in got} == {0.0}
    real = {i: (label, text) for i, (label, text) in enumerate(licenses.TEMPLATES)}
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(i, f"Some words before. {t.upper()} And after it.") for i, (_, t) in real.items()])).collect()}
    assert all(label in got[i].labels and got[i].score == 1.0 for i, (label, _) in real.items())


def test_license_base_columns_equal_sql(spark, documents):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    want = c.execute(rf"""WITH d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     p AS (SELECT string_split(a, ' ') AS p, b AS label FROM (VALUES {phrases}) v(a, b)),
     h AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, p, unnest(generate_series(1, len(w) - len(p) + 1)) AS i FROM d, p) WHERE w[i:i + len(p) - 1] = p)
     SELECT d.doc_id, len(w), count(place), min(place), max(place), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id, w""").fetchall()
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = [tuple(r[x] for x in cols) for r in licenses.op7_license_scan(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_words_that_turn_a_license_into_another(spark):
    texts = {
        "Licensed under the GNU Affero General Public License.": "agpl", "It is licensed under the GNU Lesser General Public License, as is all else.": "lgpl", "Licensed under the GNU General Public License": "gpl",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.": "cc-by-nc", "This work is licensed under a Creative Commons Attribution-ShareAlike license": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike license": "cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution license": "cc-by",
        "// SPDX-License-Identifier: MIT": "mit", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */": "bsd-3-clause,gpl", "# spdx-license-identifier: Apache-2.0": "apache-2.0", "nothing of it": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: ",".join(x for x in r.labels if x not in r.base_labels or x == "gpl") for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def plain_spans(text):
    """(template, start, end, covered words) by diagonals, with loops over words; short templates by all their words, of one license alone."""
    words, out = licenses.words_alnum(text.encode()), set()
    for t, (label, template) in enumerate(licenses.TEMPLATES):
        own = licenses.words_alnum(template.encode())
        votes = {}
        for i in range(len(words) - 2):
            for j in range(len(own) - 2):
                if words[i : i + 3] == own[j : j + 3]:
                    votes.setdefault(i - j, set()).add((i, j))
        bands, last = [], None
        for d in sorted(votes):
            if last is None or d - last > licenses.NEAR:
                bands.append(set())
            bands[-1] |= votes[d]
            last = d
        for band in bands:
            there, here = {j + x for _, j in band for x in range(3)}, {i + x for i, _ in band for x in range(3)}
            start, end = min(here), max(here) + 1
            short = len(own) <= licenses.SHORT
            alone = [j for j, w in enumerate(own) if short and {l for l, x in licenses.TEMPLATES if w in licenses.words_alnum(x.encode())} == {label}]
            if len(there) >= (licenses.MIN_SHORT if short else licenses.MIN_TEMPLATE) * len(own) and set(alone) <= there and len(here) >= licenses.MIN_SPAN * (end - start):
                out.add((t, start, end, len(there)))
    return out


def test_diagonals_equal_plain_votes(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 3)):
            part = rng.choice(licenses.TEMPLATES)[1].split()
            part = [w for w in part if rng.random() > 0.04]
            for _ in range(rng.randint(0, 3)):
                part.insert(rng.randrange(len(part) + 1), rng.choice(["so", "it", "the", "lesser"]))
            words += part[rng.choice([0, 0, len(part) // 3]) :] + ["filler"] * rng.randint(0, 9)
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)], "id long, tie long, text binary")
    got = {}
    for r in licenses.template_spans(docs).collect():
        got.setdefault(r.id, set()).add((r.template, r.start, r.end, round(r.coverage * r.n_template)))
    assert all(got.get(i, set()) == plain_spans(t) for i, t in enumerate(texts)) and sum(map(len, got.values())) > 40


def test_license_text_with_words_changed(spark):
    text = "Intro. " + licenses.TEMPLATES[2][1].replace("free of charge", "totally free of any charge") + " Outro words here."
    r = licenses.scan(frame(spark, [(1, text), (2, "permission to use is granted")])).orderBy("doc_id").collect()
    assert r[0].labels == ["mit"] and r[0].n_base == 0 and 0.6 <= r[0].score < 1 and r[1].labels == []


# 8 WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path, monkeypatch):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u\r\n5", "päge\r\n\r\nx"), (6, "u6", "b" * 300_000), (None, "u7", "alone")] + [(10 + i, "u", "copy") for i in range(200)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, key long")
    warc.register(spark)
    for compression, bound in (("gzip", 200_000), ("none", 0)):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
        folder = f"file://{tmp_path}/{compression}"
        warc.revisits(pages, "page_id", "url", "html").write.format("warc").option("compression", compression).option("archiveBytes", 20000).mode("append").save(folder)
        back = spark.read.format("warc").load(folder)
        got = {r.page_id: r for r in back.collect()}
        last = {}
        for i, _, h in rows:
            last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
        assert len(got) == len(rows)
        for i, u, h in rows:
            b, r = (h or "").encode(), got[i]
            top = None if last[h or ""] == -1 else last[h or ""]
            assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
            assert (r.record_type, r.refers_to, r.payload) == (("response", None, h or "") if i == top else ("revisit", top, None))
        assert back.filter("record_type = 'revisit' and page_id in (1, 12)").count() == 2
        light = spark.read.format("warc").option("payload", "false").load(folder).filter("page_id = 6").collect()
        assert [(r.payload_bytes, r.payload) for r in light] == [(300_000, None)]
        small = spark.read.format("warc").option("splitBytes", 3000).load(folder)  # many parts an archive
        assert sorted(small.collect(), key=str) == sorted(got.values(), key=str) and small.rdd.getNumPartitions() > 3
        assert small.filter("page_id >= 150 and record_type = 'revisit'").count() == 59 and small.filter("target_uri is null").count() == 1
        assert small.filter("target_uri like 'u%' and page_id < 7 and refers_to is not null").collect()[0].page_id == 1
        for f in (tmp_path / compression).glob("*.idx"):
            f.unlink()
        (tmp_path / compression / "manifest.json").unlink()  # as archives from elsewhere
        assert sorted(spark.read.format("warc").load(folder).collect(), key=str) == sorted(got.values(), key=str)
    twice = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (0, "c", "x"), (None, "d", None), (None, "e", "")], "page_id long, url string, html string")
    made = warc.revisits(twice, "page_id", "url", "html").collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in made) == [("0", "revisit", 1), *[("1", "response", None)] * 3, *[("None", "response", None)] * 2]
    empty = f"file://{tmp_path}/empty"
    warc.revisits(pages.limit(0), "page_id", "url", "html").write.format("warc").mode("append").save(empty)
    assert spark.read.format("warc").load(empty).count() == 0


# 9 personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, p in KINDS.items():
        for m in re.finditer(p, text, re.A):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(KINDS).index(s[0])))


def test_base_spans_equal_the_expressions(documents):
    r = random.Random(9)
    cases = [t for t in texts(documents).values() if t] + ["".join(r.choice("a1.@+-( )9é_%") for _ in range(r.randint(0, 120))) for _ in range(3000)]
    cases += ["4111 1111 1111 1111", "a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "١.2.3.4", "+1 (650) 555-0100", "256.1.1.1 1.1.1.1"]
    for t in cases:
        assert pii.base_spans(t) == brute_spans(t)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"note password={'%018x' % ((i + 1) * 7919 ** 5)} end") for i in range(30)] + [(100 + i, f"the passcode: {'%018x' % ((i + 1) * 104729 ** 4 % (1 << 72) | 0xA)} ok") for i in range(12)]
    rows += [(200 + i, f"Version 2.0 of chapter 12, page {i}.") for i in range(20)] + [(300, "mail a.b@c.org password=hunter2hunter2x9"), *ODD]
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in pii.personal_data(frame(spark, rows)).collect()}
    found = {i for i, s in got if any(k == "id" for k, _, _ in s)}
    assert set(range(30)) <= found and set(range(100, 112)) <= found and not found & set(range(200, 220))
    red = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert red[300].text.startswith("mail <EMAIL> password=<ID>") and red[1].n_words == 9 and red[200].text == rows[42][1]
    assert pii.redact(frame(spark, rows)).filter("doc_id = 1 and text is null").count() == 1


def test_identifiers_of_any_length_are_found(spark):
    rows = [(i, f"the passcode: {'%0300x' % ((i + 1) * 104729 ** 4)} and password={'%0200x' % ((i + 7) * 7919 ** 9)} ok") for i in range(12)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "id"] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all((t.index("password=") + 9, t.index(" ok")) in got[i] for i, t in rows)
    many = " ".join(f"a{i}@b.cc" for i in range(9)) + " 1.2.3.4"
    assert [s[4] for s in pii.instances(many, pii.base_spans(many))] == []  # what lies in base spans is no instance
    assert pii.overlaps([("ip", 0, 2), ("ip", 3, 4), ("ip", 5, 6), ("ip", 7, 8), ("ip", 9, 10), ("ip", 11, 99)], 0, 20, 30)


def test_base_columns_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')),
     len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)),
     len(list_filter(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) FROM documents""").fetchall()
    assert sorted(want) == sorted((r.doc_id, r.n_email, r.n_ip, r.n_phone) for r in pii.op9_personal_data(spark, SF).collect())
    want = c.execute(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d)
     SELECT doc_id, len(w), coalesce(list_sum(list_transform(w, lambda y: length(y))), 0), len(regexp_extract_all(x, '[#*$%&|<>]')), len(l) - len(list_distinct(l)) FROM w""").fetchall()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    assert sorted(map(tuple, want)) == sorted(tuple(r[x] for x in cols) for r in quality.op4_line_quality(spark, SF).collect())


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "id"] for r in pii.personal_data(docs).collect()}


def test_base_entities_vouch_only_for_values_of_their_shape(spark):
    texts = [f"contact: user{i}@mail.example" for i in range(6)] + [f"ip: 10.0.0.{i}" for i in range(6)] + ["contact: Johnathan Smith", "ip: unknown", "ip: pending", "note: nothing"]
    assert all(v == [] for v in found(spark, texts).values())


def test_keys_have_digits_and_any_length(spark):
    texts = ["password2=hunterhunterx", "DB_PASSWORD1: correcthorse", "a_very_long_environment_variable_name_for_db_password=swordfishes", "at 12:30 they came", "x=1"]
    assert list(found(spark, texts).values()) == [["hunterhunterx"], ["correcthorse"], ["swordfishes"], [], []]
    assert pii.key_before("a_very_long_environment_variable_name_for_db_host=", 49) == "a_very_long_environment_variable_name_for_db_host"
    far = "his   staff" + " " * 200 + "badge number:  (" 
    assert pii.words_before(far, len(far)) == "staff badge number" and pii.words_before("one two 3 ", 10) == ""


@pytest.mark.parametrize("seed", range(3))
def test_graph_scores_equal_plain_rounds(spark, seed):
    rng = random.Random(seed)
    patterns = [f"key k{i} mixed" for i in range(8)] + [f"left a b c{i}" for i in range(6)] + ["make mixed20"]
    values = {f"v{i}": (rng.sample(patterns, rng.randint(1, 3)), rng.random() < 0.35, rng.randint(1, 4)) for i in range(90)}
    rows = [(i, 0, 0, 1, v, ps, seed_) for i, (v, (ps, seed_, n)) in enumerate(values.items()) for _ in range(n)]
    df = spark.createDataFrame(rows, "id long, tie long, start int, end int, value string, patterns array<string>, seed boolean")
    sure = {v: float(s) for v, (_, s, _) in values.items()}
    for _ in range(pii.ROUNDS):
        weight = {}
        for p in patterns:
            own = [sure[v] for v, (ps, _, _) in values.items() if p in ps]
            weight[p] = sum(own) / (len(own) + (pii.SMOOTH_LEFT if p.startswith("left ") else pii.SMOOTH))
        fresh = {}
        for v, (ps, s, _) in values.items():
            doubt = 1.0
            for p in ps:
                doubt *= 1 - min(weight[p], 0.999) if weight[p] >= pii.SURE_PATTERN else 1
            fresh[v] = max(float(s), 1 - doubt)
        sure = fresh
    got = {r.value: r.n for r in pii.sure_instances(df).collect()}
    assert got == {v: values[v][2] for v, s in sure.items() if s >= pii.SURE_INSTANCE}


def test_whole_values_behind_keys_and_cues(spark):
    cases = {
        1: ("so password = correcthorsebattery end", "correcthorsebattery"), 2: ("token=" + "a1" * 70, "a1" * 70), 3: ("secret: wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY=.", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY="),
        4: ("my passport number is X1234567, ok", "X1234567"), 5: ('{"pwd": "a b\u00e9 c"}', "a b\u00e9 c"), 6: ("http://h/p?token=abc&b=1", "abc"), 7: ("token=1.2.3.4xyz", "1.2.3.4xyz"), 8: ("the secret is out", None), 9: ("note: plain words", None),
    }
    got = pii.personal_data(frame(spark, [(i, t) for i, (t, _) in cases.items()])).collect()
    assert {r.doc_id: [cases[r.doc_id][0][s.start : s.end] for s in r.spans if s.kind == "id"] for r in got} == {i: [v] if v else [] for i, (_, v) in cases.items()}
    rows = [(i, f"passcode: {'%018x' % ((i + 1) * 104729 ** 4 % (1 << 72) | 0xA)} ok") for i in range(6)] + [(100 + i, f"password={'%018x' % ((i + 1) * 7919 ** 5)}") for i in range(30)] + [(50, "passcode: open/sesame+ now")]
    assert {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}[50] == "passcode: <ID> now"


def test_long_runs_cost_little():
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@" + "b" * 200_000) == []


# 10 language ID


def test_languages_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language.identify(d).filter((remainder(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull()).select("lang", "language").collect()
    assert np.mean([x.lang == x.language.lang for x in r]) > 0.95 and all(0 <= x.language.score <= 1 for x in r)


def test_scores_are_kernel_ridge(spark):
    """The collapsed product against kernels by sets and a plain solution of the ridge."""
    r = random.Random(10)
    alphabets = {"aa": "abcde ", "bb": "defgh ", "cc": "ghijk "}
    texts_ = [("".join(r.choice(a) for _ in range(r.randint(20, 60))) + a[0], lang) for lang, a in alphabets.items() for _ in range(12)]
    mark = np.zeros(language.BINS, bool)
    rows = [language.bins(t, mark) for t, _ in texts_]
    model = language.KernelClassifier.fit(rows, [x for _, x in texts_], landmarks=9)
    grams = lambda t: {(n, t[i : i + n]) for b in [f" {t} ".encode()] for t in [b] for n in (2, 3, 4) for i in range(len(t) - n + 1)}
    sets = [grams(t) for t, _ in texts_]
    assert all(abs(len(a) - len(b)) <= 2 for a, b in zip(sets, rows))  # hashed bins seldom meet
    pick = [i for k in range(3) for i in (k, 12 + k, 24 + k)]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    K, L = (np.array([[kernel(a, sets[j]) for j in pick] for a in of]) for of in (sets, [sets[i] for i in pick]))
    y = np.array([[1.0 if x == lang else -1.0 for lang in alphabets] for _, x in texts_])
    w = np.linalg.solve(K.T @ K + language.RIDGE * len(K) * L, K.T @ y)
    want = K @ w
    got = language.products(rows, model.matrix) / np.sqrt([len(x) for x in rows])[:, None]
    assert np.abs(want - got).max() < 0.05 and (want.argmax(1) == got.argmax(1)).all()
    assert not mark.any()


def test_rows_that_share_an_id_are_sampled_by_their_texts(spark):
    english = [(1, f"the house and the garden were sold to the man with the dog {i}", "en") for i in range(1200)]
    german = [(None if i % 2 else i, f"das haus und der garten wurden an den mann mit dem hund verkauft {i}", "de") for i in range(700)]
    copies = [(9, "la maison et le jardin ont été vendus", "fr")] * 900
    docs = spark.createDataFrame(english + german + copies, "doc_id int, text string, lang string")
    got = language.identify(docs, train=F.lit(True)).groupBy("lang").agg(F.count_if(F.col("lang") == F.col("language.lang")).alias("right"), F.count("*").alias("n")).collect()
    assert {("en", 1200), ("de", 700)} < {(r.lang, r.right) for r in got}
    bins, labels, whole = language.labelled_sample(docs, "doc_id", "text", "lang", F.lit(True))
    assert {x: sum(labels[i] == x for i in whole) for x in set(labels)} == {"en": 400, "de": 400, "fr": 1}


def test_many_languages_and_long_texts(spark):
    rows = [(4 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * (5 + j)) for i in range(230) for j in range(3)]
    df = spark.createDataFrame([(i, t, t[:3]) for i, t in rows] + [(5000, "abq " * 300_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.language.lang for r in language.identify(df, train=F.lit(True)).collect()}
    assert len(set(got.values())) == 230 and got[5000] == "abq"


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "12 34 !?", "٣", "the house and the garden", "²½"])] + [(20 + i, "the cat and the dog are here") for i in range(20)]
    got = {r.doc_id: r.language for r in language.identify(frame(spark, rows)).collect()}
    assert [got[i].lang for i in (0, 1, 2, 3, 5)] == ["und"] * 5 and got[4].lang == "en"


# all


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_odd_tables_are_whole(spark, rows, tmp_path):
    d = frame(spark, rows)
    lab = spark.createDataFrame([(4, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    frames = [
        pieces.sentencepiece_ids(d), decontaminate.contamination(d, items), quality.line_first(d), toxicity.toxicity(d, lab.limit(0) if not rows else lab),
        jaccard.jaccard_components(d), licenses.scan(d), pii.personal_data(d), pii.redact(d), language.identify(d),
    ]
    assert [f.count() for f in frames] == [len(rows)] * len(frames)
    m = token_store.write_tokens(d, "doc_id", "text", f"file://{tmp_path}/t", tokenizer_path("byte_bpe_50k.json"), 2)
    assert token_store.read_digests(token_store.with_starts(m)).count() == len(rows)


def test_written_tables_and_free_names(spark):
    df = spark.createDataFrame([(1,)], T.StructType([T.StructField("_OP", T.LongType())]))
    assert free_name(df, "_op") == "__op" and written(df, "x").collect() == df.collect()
