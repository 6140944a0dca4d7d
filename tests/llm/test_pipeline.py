from __future__ import annotations

import random

from sample_texts import prose

import __spark_entry__
import corpus_pipeline
from kestrelog.llm import registry


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(15)
    bad = ["vilest", "scoundrel", "rotten"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        docs.append((i, prose(rng, rng.randint(60, 90)) + ("".join(" " + rng.choice(bad) for _ in range(5)) if toxic else ""), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[4 * i + 1][1], "en", "s1", 0) for i in range(10)]  # copies
    item = prose(rng, 30)
    docs += [(2000 + i, prose(rng, 40) + " " + item, "en", "s2", 0) for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    left = [{d[0] for d in docs}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == held.columns
        out.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        left.append({r.doc_id for r in held.select("doc_id").collect()})
        assert left[-1] <= left[-2]
    toxic = {i for i in range(0, 400, 4)}
    assert not left[1] & toxic and left[1] >= left[0] - toxic
    assert left[2] == left[1] - set(range(1000, 1010))
    assert left[3] == left[2] - set(range(2000, 2005))
    assert len(left[4]) > 0.4 * len(left[3]) and left[5] == left[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == left[5]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Null and blank texts, repeated and null ids, a long text, extra columns with clashing names; then no rows at all."""
    from sample_texts import ODD

    names = "doc_id long, text string, lang string, source string, n_chars long, __chance double, __source string, fp long, band long"
    rng = random.Random(21)
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", 0, 0.5, "x", 1, 2) for i, t in enumerate(ODD)]
    rows += [(50 + i, prose(rng, 40), "en", "s", 0, 0.5, "x", 1, 2) for i in range(30)] + [(51, "twice", "en", "s", 0, 0.5, "x", 1, 2), (None, "no id", None, None, None, None, None, None, None)]
    labels = [(50 + i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (51, 1, None)]
    for k, (docs, marks, items) in enumerate([(rows, labels, [(1, prose(rng, 30)), (None, "x y"), (2, None)]), ([], [], []), (rows, [], [])]):
        home = tmp_path / str(k)
        spark.createDataFrame(docs, names).write.parquet(str(home / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(home / "labels.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(home / "benchmark.parquet"))
        held = spark.read.parquet(str(home / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, str(home))
            if name != "token_ids":
                assert out.columns == held.columns
            out.write.parquet(str(home / name))
            held = spark.read.parquet(str(home / name))
        found = {r.doc_id for r in held.collect()}
        assert found <= {r[0] for r in docs}
        if k == 2:
            assert {None, 9, 51} <= found | {None, 9, 51} and len(found) > 15


def test_registered():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert {*names, "pipeline"} <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(names)
