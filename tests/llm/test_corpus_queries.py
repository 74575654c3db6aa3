"""The registered corpus queries and the pipeline, over whole small tables; those with SQL against DuckDB."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tocsin.llm import queries
from tocsin.llm.common import table, tokenizer_path, written

from test_corpus_operators import brute_components, brute_contamination, brute_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    key = "page_id" if name.startswith("op8") else "doc_id"
    source = table(spark, SF, "pages" if key == "page_id" else "documents")
    rows = got.collect()
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in source.select(key).collect())
    if sql := queries.ORACLE_SQL.get(name):
        c = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted((tuple(r[x] for x in names) for r in rows), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "duplicates", "decontamination", "personal_data", "tokens"]
    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "test")
        if name != "tokens":
            assert out.columns == docs.columns
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100 and docs.filter("not restored").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def fixture(spark, folder, rows, items):
    """documents and benchmark under folder, with a column more and a null language here and there."""
    d = spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _tie long")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return d


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(30)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, rows = " ".join(say(14)), []
    for i in range(60):
        w = say(r.randint(6, 90))
        if i % 7 == 0:
            w[2:2] = [f"a{i}@mail.example", "10.1.2.3", "+1 (650) 555-0100"]
        if i % 9 == 0:
            w[4:4] = passage.split()[: r.choice([9, 12])]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 3)] + [(200 + i, rows[i][1] + " end") for i in range(0, 60, 4)]
    rows += [(300, None), (301, ""), (302, " 12 ?! "), (303, "x"), (304, "x"), (305, "é" * 30_000), (306, "password=hunter2hunter2x9 stays not"), (None, rows[1][1]), (None, "one that has no id"), (7, "the same id again with another text"), (7, "the same id again with another text")]
    docs = fixture(spark, tmp_path, rows, [(1, passage), (2, None), (3, "")])
    stages = dict(corpus_pipeline.STAGES)

    lettered = [x for x in rows if x[1] and any(map(str.isalpha, x[1]))]
    kept = written(stages["language"](spark, docs, str(tmp_path)), "test")
    assert sorted(map(str, ((x.doc_id, x.text) for x in kept.collect()))) == sorted(map(str, lettered)) and kept.columns == docs.columns

    distinct = sorted(set(lettered), key=lambda x: (x[0] is None, x[0] or 0))
    group = brute_components(list(enumerate(t for _, t in distinct)))
    first = [x for k, x in enumerate(distinct) if group[k][1] == k]
    kept = written(stages["duplicates"](spark, kept, str(tmp_path)), "test")
    assert sorted(map(str, ((x.doc_id, x.text) for x in kept.collect()))) == sorted(map(str, first)) and kept.columns == docs.columns

    clean = [x for x in first if not brute_contamination(x[1], [(1, passage)])[1]]
    kept = written(stages["decontamination"](spark, kept, str(tmp_path)), "test")
    assert sorted(map(str, ((x.doc_id, x.text) for x in kept.collect()))) == sorted(map(str, clean)) and 0 < len(clean) < len(first) < len(lettered)

    def masked(text):
        out = text.replace("hunter2hunter2x9", "<ID>")
        for kind, s, e in reversed(brute_spans(out)):
            out = f"{out[:s]}<{kind.upper()}>{out[e:]}"
        return out

    kept = written(stages["personal_data"](spark, kept, str(tmp_path)), "test")
    got = {(x.doc_id, x.text): x for x in kept.collect()}
    assert set(got) == {(i, masked(t)) for i, t in clean} and all(x.n_chars == len(t) for (_, t), x in got.items())

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = []
    for i, t in got:
        ids = sp.encode(t)
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, ids))
    last = stages["tokens"](spark, kept, str(tmp_path))
    assert sorted(map(str, map(tuple, last.collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = fixture(spark, tmp_path, [], [])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.count() == 0 and (name == "tokens" or "_tie" in docs.columns)


def test_pipeline_leaves_the_tables_of_other_results(spark):
    lazy = queries.QUERIES["op9_personal_data"](spark, "/root/testdata/sf0.001")
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert lazy.count() == table(spark, "/root/testdata/sf0.001", "documents").count()


def test_registry():
    q = entry.queries()
    assert "pipeline" in q and all(n in q for n in queries.QUERIES) and set(entry.oracle_sql()) <= set(q)
