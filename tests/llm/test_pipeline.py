"""The pipeline over the smallest table: every stage against a plain version of its decision."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from millrace.llm import decontaminate, mixing
from millrace.llm.queries import QUERIES, quality_model
from tests.llm.test_operators import components, shingles


def in_duckdb(df, sf_dir, sql):
    """``sql`` over these documents and the benchmark of the folder."""
    documents = df.toPandas()  # noqa: F841, found by its name
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{sf_dir}/benchmark.parquet'")
    return con.execute(sql).fetchall()


def plain_quality(model, text):
    """The score of one text: sizes under both dictionaries for each piece of it."""
    x, pack = np.zeros(3), model.coders()
    if text:
        sizes = [[len(c.compress(text[i : i + 2048].encode())) for c in pack] for i in range(0, len(text), 2048)]
        each, (g, b) = [(b - g) / (b + g) for g, b in sizes], np.sum(sizes, axis=0)
        x = np.array([(b - g) / (b + g), max(each), min(each)])
    return 1 / (1 + np.exp(-min(30, max(-30, model.weights[0] + model.weights[1:] @ (10 * x)))))


def plain_lines(rows):
    """Text of each document without the lines that three documents and over a tenth of its source hold."""
    total, holds = Counter(r.source for r in rows), Counter()
    for r in rows:
        holds.update({(r.source, x) for x in (r.text or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in holds.items() if n >= 3 and n > 0.1 * total[k[0]]}
    return {r.doc_id: r.text and "\n".join(x for x in r.text.split("\n") if (r.source, x) not in bad) for r in rows}


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = cp.quality_stage(spark, docs, sf_dir).cache()
    model = quality_model(spark, docs, sf_dir)
    good = [r.doc_id for r in docs.collect() if plain_quality(model, r.text) >= 0.7]
    assert sorted(r.doc_id for r in step.select("doc_id").collect()) == sorted(good) and 0 < len(good) < docs.count()
    lines = cp.line_stage(spark, step, sf_dir).cache()
    want = plain_lines(step.collect())
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text) and any(r.text != want[r.doc_id] for r in step.collect())
    near = cp.near_copy_stage(spark, lines, sf_dir).cache()
    sets = {r.doc_id: shingles(r.text, 5) for r in lines.collect()}
    want = components(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b))
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(i for i, c in want.items() if i == c)
    clean = cp.benchmark_stage(spark, near, sf_dir).cache()
    leaking = {r[0] for r in in_duckdb(near, sf_dir, decontaminate.sql())}
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in near.collect() if r.doc_id not in leaking)
    mixed = cp.mixing_stage(spark, clean, sf_dir)
    names = ("doc_id", "source", "epoch", "block", "position", "n_words")
    want = in_duckdb(clean, sf_dir, f"select {', '.join(names)} from ({mixing.sql()})")
    run = cp.run(spark, sf_dir)
    assert sorted(tuple(r[c] for c in names) for r in mixed.collect()) == sorted(want)
    assert sorted(tuple(r[c] for c in names) for r in run.collect()) == sorted(want)


def test_pipeline_leaves_only_its_last_table(spark, sf_dir):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    rows = cp.run(spark, sf_dir)
    new = sorted(set(os.listdir(root)) - before)
    assert len(new) == 1 and new[0].startswith("pipeline-") and os.listdir(f"{root}/{new[0]}") == ["t5"] and rows.count() > 0


@pytest.mark.parametrize(("name", "n", "fold", "least"), [("op8_quality", 4, 2, 0.7), ("op10_toxicity", 5, 0, 0.5)])
def test_folds_and_predictions(spark, sf_dir, name, n, fold, least):
    """The fold, the range and the threshold of every document, by another crc32."""
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_pipeline_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty, repeated and long texts, extra columns, and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.limit(60).collect()
    keep = max((r for r in some if r.text), key=lambda r: len(r.text))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, keep.text, "en", "s", 1), (9003, keep.text, "en", None, 1), (9003, keep.text, "en", None, 1)]
    rows += [(9004, keep.text * 200, "en", "s", 1)]
    wide = spark.createDataFrame(rows, docs.schema).selectExpr("*", "'x' as component_id", "1 as n", "'y' as site")
    wide.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for t in ("labels", "benchmark"):
        for d in "ab":
            spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{d}/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0
    step = wide
    for _, stage in cp.STAGES[:-1]:
        step = stage(spark, step, f"{tmp_path}/a")
        assert step.columns == wide.columns
    left = {r.doc_id for r in step.collect()}
    assert left <= {r[0] for r in rows}
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/a").collect()} <= left
    near = cp.near_copy_stage(spark, cp.line_stage(spark, wide, f"{tmp_path}/a"), f"{tmp_path}/a")
    ids = [r.doc_id for r in near.collect()]
    assert {9001, 9002, None} <= set(ids) and 9003 not in ids


def test_queries_with_sql(spark, sf_dir):
    import glob

    from millrace.llm.queries import SQL

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
