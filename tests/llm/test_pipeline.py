import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from dayledger.llm import simhash
from dayledger.session import kept

from .helpers import sentence

FOLDER = "/root/testdata/sf0.001"


def stages(spark, folder, docs):
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(kept(stage(spark, made[-1], folder)))
    return made


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    _, good, lines, single, mixed, packed = stages(spark, FOLDER, docs)
    for df in (good, lines, single, mixed):
        assert df.schema == docs.schema
    assert 0 < good.count() < docs.count() and lines.count() == good.count()
    assert lines.agg(F.sum("n_chars")).first()[0] < good.agg(F.sum("n_chars")).first()[0]
    assert lines.where("n_chars <> length(text)").count() == 0
    copies = simhash.near_copies(lines)
    assert single.count() == copies.select("component_id").distinct().count()
    assert {r[0] for r in mixed.select("doc_id").collect()} <= {r[0] for r in single.select("doc_id").collect()}
    assert packed.where("start = 0").count() == mixed.count()
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(packed.collect())


def test_hard_documents(spark):
    rng = random.Random(1)
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(i, sentence(rng, 40) + "\n" + sentence(rng, 6), "en", "s", 1) for i in range(40)]
    rows += [(None, None, None, None, None), (41, "", None, None, 0), (41, "", None, None, 0)]
    rows += [(50, rows[0][1], "en", None, None), rows[1], (51, sentence(rng, 20_000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    _, good, lines, single, mixed, packed = stages(spark, FOLDER, docs)
    kept_ids = {r["doc_id"] for r in good.collect()}
    # Texts lose lines that an earlier document has, and only those.
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert texts.keys() == kept_ids
    whole = {r["doc_id"]: r["text"] for r in good.collect()}
    assert all(set(t.split("\n")) <= set((whole[i] or "").split("\n")) for i, t in texts.items())
    if {0, 50} <= kept_ids:
        assert texts[0] == whole[0] and texts[50] == ""
    # One document of each group stays; those without an id all stay.
    ids = [r["doc_id"] for r in single.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) <= kept_ids
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}
    assert packed.where("start = 0").count() == mixed.count() > 0
    assert packed.agg(F.max("length")).first()[0] <= 4096
    assert stages(spark, FOLDER, spark.createDataFrame([], schema))[-1].count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
