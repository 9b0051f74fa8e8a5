import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayledger.llm import mixing

from .helpers import hard_docs, none_of, sentence


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Shares the excess again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return held | part
        held |= {s: cap * sizes[s] for s in over}


def test_hard_documents(spark):
    docs = hard_docs(spark, random.Random(1), 200)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    words = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in rows), key=str) == sorted(words, key=str)
    sizes = {}
    for _, source, n in words:
        sizes[source] = sizes.get(source, 0) + n
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]


def test_words_taken_come_near_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randint(1, 60)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = mixing.mix(docs, chunk=100)
    again = mixing.mix(docs.orderBy(F.rand(3)).repartition(7), chunk=100)
    assert sorted(first.select("doc_id", "taken").collect()) == sorted(again.select("doc_id", "taken").collect())
    sums = first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for r in sums.collect():
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]


def test_flight_keeps_both_totals_and_leaves_two():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 500, 400).astype(float)
    chance = rng.random(400)
    moved = mixing.flight(size, chance, rng.random(400))
    assert moved.sum() == pytest.approx(chance.sum())
    assert (moved * size).sum() == pytest.approx((chance * size).sum())
    assert ((moved > 0) & (moved < 1)).sum() <= 2


def test_flight_keeps_each_chance_on_average():
    rng = np.random.default_rng(5)
    size, chance = rng.integers(1, 50, 12).astype(float), rng.uniform(0.1, 0.9, 12)
    mean = np.mean([mixing.flight(size, chance, rng.random(12)) for _ in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.04


def test_mixed_repeats_documents_and_keeps_columns(spark):
    docs = hard_docs(spark, random.Random(6))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert out.count() == copies


def test_repeated_rows_come_near_the_target(spark):
    """A source of one row repeated 1,000 times, one with some repeated rows, and others."""
    rng = random.Random(8)
    rows = [(7, sentence(rng, 12), "s0", "x")] * 1000
    rows += [(i, sentence(rng, rng.randint(1, 40)), f"s{i % 3 + 1}", "y") for i in range(900)]
    rows += [rows[1500]] * 11
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    told = mixing.mix(docs)
    assert told.count() == len(rows) and told.where("taken > 2 * size").count() == 0
    sums = told.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in sums)
    counts = {}
    for r in told.where("source = 's0'").collect():
        counts[r["copies"]] = counts.get(r["copies"], 0) + 1
    assert len(counts) == 2 and max(counts) - min(counts) == 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == told.agg(F.sum("copies")).first()[0]
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert taken == {r["source"]: r["n"] for r in told.groupBy("source").agg(F.sum("copies").alias("n")).collect()}


def test_empty_tables_and_texts(spark):
    docs = hard_docs(spark, random.Random(7))
    assert mixing.mix(none_of(docs)).count() == 0 and mixing.mixed(none_of(docs)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(blank).collect())
