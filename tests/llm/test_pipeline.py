"""The pipeline's stages, each on what the one before kept, and the registered queries."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import ODD, prose
from tests.llm.test_operators import brute_copies, family
from tickerloom.llm import base, nearcopies

SMALL = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in names) if m} == set(range(1, 14))
    assert set(entry.llm.ORACLES) <= names


def test_stages_keep_columns_and_take_effect(spark, docs):
    data = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("size", F.lit("clash"))
    counts = [data.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = base.settled(stage(spark, data, SMALL), "stage")
        assert out.dtypes == data.dtypes, name
        counts.append(out.count())
        data = out
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, data, SMALL)
    whole = last.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.expr("offset + length")).alias("end"))
    assert whole.filter("n <> end OR n > 4096").count() == 0


def test_stages_take_odd_and_empty_tables(spark, docs):
    for rows in (ODD, []):
        data = docs(rows, clash=True)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, data, SMALL).count()


def test_copies_go_and_clean_documents_stay(spark, docs):
    stop = "the of and to a in is that it for was on".split()

    def text(k):
        lines = (prose(100 * k + j, 12).split() for j in range(12))
        return "\n".join(" ".join(f"{stop[(j * 5 + n * n) % 12]} {w}" for n, w in enumerate(line)) for j, line in enumerate(lines))

    clean = [text(k) for k in range(6)]
    data = docs([*((k, t, f"s{k}") for k, t in enumerate(clean)), (10, clean[0], "s0"), (11, clean[1] + " also", "s1")])
    kept = data
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = base.settled(stage(spark, kept, SMALL), "stage")
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {0, 1, 2, 3, 4, 5} <= set(texts) and all(texts[k] == clean[k] for k in range(6))
    assert sum(len(t) for i, t in texts.items() if i > 5) < len(clean[1]) // 2


def test_run_gives_the_stages_result(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0


def test_near_dedup_keeps_what_brute_force_keeps(spark, docs, monkeypatch):
    monkeypatch.setattr(nearcopies, "FEW", 4)
    texts = family(6, 150, 40)
    got = corpus_pipeline.near_dedup(spark, docs(list(enumerate(texts))), SMALL)
    assert {r.doc_id for r in got.collect()} == set(brute_copies(texts))


def test_columns_with_the_operators_own_names_keep_their_values(spark, docs):
    lines = "\n".join(f"{prose(k, 9)} the of and" for k in range(4))
    data = docs([(1, lines), (2, lines + "\nlast line of it"), (3, None), (3, None)])
    own = {c: F.lit(f"own {c}") for c in ("n_lines", "N_removed", "fp", "size", "bits", "keys", "root", "id", "times", "mine")}
    data = data.select("*", *(e.alias(c) for c, e in own.items()))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, data, SMALL)
        assert out.columns == data.columns, name
        assert out.select(*own).distinct().collect() == data.select(*own).distinct().collect(), name
    texts = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, data, SMALL).collect()}
    assert texts == {1: lines, 2: "last line of it", 3: None}
