"""License scans by diagonal voting.

Every k-word gram of every text is joined in Spark to the places of the same gram in the license templates (a fixed set, so
its broadcast doesn't grow). A hit votes for the diagonal text position minus template position. Hits are grouped by
diagonal, neighbouring diagonals (words inserted or left out) are merged, and a merged span is verified: it must hold
enough of the template's words, and be made of them rather than of gaps. A short template needs nearly all its words, and all that
templates of no other license have.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, grams, parts, per_row, small_batches, table, word_hashes, words_alnum

#: Words in a gram; how far apart diagonals may be to count as one; least share of the template, and of the span, that is covered.
K, NEAR, MIN_TEMPLATE, MIN_SPAN = 3, 6, 0.6, 0.5
#: Words up to which a template is short, and the share of it that must be covered then.
SHORT, MIN_SHORT = 16, 0.8
#: Rows of one batch of grams.
GRAM_ROWS = 200_000
#: The phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public license notices and the labels that they stand for.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software"),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU Lesser General Public License for more details"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits"),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("odbl", "This database is made available under the Open Database License"),
)

#: Words that turn a license into another one.
VARIANTS = frozenset("affero lesser noncommercial noderivatives noderivs sharealike".split())
#: Words after a span in which such a word counts as well.
AFTER = 3
#: What SPDX names begin with, the longest first, and their labels; any other name is a label as it stands, in lower case.
SPDX = {"cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by-": "cc-by", "agpl-": "agpl", "lgpl-": "lgpl", "gpl-": "gpl", "cc0-": "cc0", "bsd-2-clause": "bsd", "bsl-": "boost"}
SPDX_LINE = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]+)", re.I)
SPDX_NAME = re.compile(rb"[A-Za-z0-9][A-Za-z0-9.+-]*")


def variant_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Where words of VARIANTS stand; non commercial, in two words, is one of them."""
    out = []
    for i, w in enumerate(words):
        name = b"noncommercial" if w == b"commercial" and i and words[i - 1] == b"non" else w
        if len(name) > 5 and name.decode(errors="replace") in VARIANTS:
            out.append((i, name.decode()))
    return out


def spdx_labels(text: bytes) -> list[str]:
    """Labels of the names in SPDX lines, without what follows WITH."""
    out = set()
    for line in SPDX_LINE.findall(text):
        names, skip = SPDX_NAME.findall(line.split(b"*/")[0].split(b"-->")[0]), False
        for name in (n.decode().lower() for n in names):
            if name in ("and", "or", "with"):
                skip = name == "with"
            elif not skip:
                out.add(next((label for start, label in SPDX.items() if name.startswith(start)), name))
            else:
                skip = False
    return sorted(out)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """gram, template, label, n_template (its words), at (the gram's first word in it), least (the share that must be covered), need (places of
    words that must be) and variants (its own words of VARIANTS)."""
    rows, labels = [], defaultdict(set)
    for label, text in templates:
        for w in words_alnum(text.encode()):
            labels[w].add(label)
    for t, (label, text) in enumerate(templates):
        words = words_alnum(text.encode())
        short = len(words) <= SHORT
        need = [i for i, w in enumerate(words) if short and labels[w] == {label}]
        own = [name for _, name in variant_places(words)]
        rows += [(int(g), t, label, len(words), i, MIN_SHORT if short else MIN_TEMPLATE, need, own) for i, g in enumerate(grams(word_hashes(text.encode(), ALNUM), k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, label string, n_template int, at int, least double, need array<int>, variants array<string>")


def text_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """id, tie, pos, gram of every k-word gram; docs has id, tie and the text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0

        def out() -> pa.RecordBatch:
            n = [len(g) for _, _, g in held]
            ids = pa.array([i for i, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            return pa.RecordBatch.from_arrays([
                ids, pa.array(np.repeat(np.array([t for _, t, _ in held], np.int64), n)),
                pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in n])), pa.array(np.concatenate([g for _, _, g in held]).view(np.int64)),
            ], ["id", "tie", "pos", "gram"])

        for b in parts(batches, "text"):
            for i, tie, text in zip(*(c.to_pylist() for c in b.columns)):
                g = grams(word_hashes(text, ALNUM), k)
                if len(g):
                    held.append((i, tie, g))
                    rows += len(g)
                    if rows >= GRAM_ROWS:
                        yield out()
                        held, rows = [], 0
        if held:
            yield out()

    return small_batches(docs).mapInArrow(run, "id long, tie long, pos int, gram long")


def template_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """id, tie, template, label, start, end (words, end exclusive) and coverage of the verified spans."""
    hits = text_grams(docs, k).join(F.broadcast(template_grams(docs.sparkSession, k=k)), "gram")
    own = ["id", "tie", "template", "label", "n_template", "least", "need", "variants"]
    diagonals = hits.groupBy(*own, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    w = Window.partitionBy("id", "tie", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEAR, F.lit(True))
    spans = diagonals.withColumn("new", apart.cast("int")).withColumn("band", F.sum("new").over(w))
    spans = spans.groupBy(*own, "band").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("places", lambda p: p + F.col("diagonal"))))).alias("hits"),
        F.min("first").alias("start"), (F.max("last") + k).alias("end"),
    )
    words = lambda starts: F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + k - 1))))
    spans = spans.withColumn("coverage", F.size(words("places")) / F.col("n_template"))
    whole = (F.col("coverage") >= F.col("least")) & (F.size(F.array_except("need", words("places"))) == 0)
    return spans.filter(whole & (F.size(words("hits")) >= MIN_SPAN * (F.col("end") - F.col("start"))))


def phrase_places(text: bytes | None) -> tuple:
    """n_words, the number of all places of all phrases, the smallest and largest start, the sorted labels; then the places of words that
    turn licenses into others, and the labels of SPDX lines."""
    words = words_alnum(text)
    line = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.encode()
        if b" " + p + b" " in line:
            w = p.split()
            at = [i for i, x in enumerate(words) if x == w[0] and words[i : i + len(w)] == w]
            starts += at
            labels.add(label)
    some = [{"place": i, "word": w} for i, w in variant_places(words)]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), some, spdx_labels(text or b"")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    base_labels and labels are sorted arrays; spans are the verified template spans. score is the best coverage of a
    template, 1.0 where a base phrase or an SPDX line stands, 0.0 where nothing does. What is said about a license is not understood: a
    text that is not under it, and says so, has its label, too. Null text counts as empty and has nothing; rows that
    repeat id and text have equal results; a null id is kept. A very long text is held alone, whole; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    base = per_row(rows, "text", lambda: phrase_places, "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, variants array<struct<place:int,word:string>>, spdx array<string>", "base", ["id", "tie"])
    spans = template_spans(rows).groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "coverage", "variants"))).alias("spans"))
    a, b = base.alias("a"), spans.alias("b")
    out = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.tie") == F.col("b.tie")), "left")
    # a span with a word of another license in it, or right behind it, isn't of its own license
    turned = lambda s: F.exists("base.variants", lambda v: (v.place >= s.start) & (v.place < s.end + AFTER) & ~F.array_contains(s.variants, v.word))
    out = out.withColumn("spans", F.filter("spans", lambda s: ~turned(s)))
    # of spans that lie half or more in one another, as those of related licenses do, the best covered stays, and of equals the longest
    inside = lambda s, o: 2 * (F.least(s.end, o.end) - F.greatest(s.start, o.start)) >= s.end - s.start
    better = lambda s, o: (o.coverage > s.coverage) | ((o.coverage == s.coverage) & (o.end - o.start > s.end - s.start))
    out = out.withColumn("spans", F.filter("spans", lambda s: ~F.exists("spans", lambda o: better(s, o) & inside(s, o))))
    out = out.withColumn("spans", F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.label.alias("label"), s.coverage.alias("coverage"))))
    labels = F.array_sort(F.array_union(F.array_union("base.base_labels", "base.spdx"), F.coalesce("spans.label", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)), ((F.col("base.n_base") > 0) | (F.size("base.spdx") > 0)).cast("double"))
    first = [F.col(f"base.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")]
    return out.select(F.col("a.id").alias(id_col), *first, F.when(F.size("spans") > 0, F.col("spans")).alias("spans"), labels.alias("labels"), F.least(score, F.lit(1.0)).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, places and labels, all labels and the score of every document; odd rows as in scan()."""
    out = scan(table(spark, sf_dir, "documents"))
    text = lambda c: F.concat_ws(",", F.col(c)).alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text("base_labels"), text("labels"), "score")
