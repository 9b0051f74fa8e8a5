import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayledger.llm import common, quality, toxicity

from .helpers import hard_docs, none_of, sentence


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def graded(spark):
    """Good prose, bad noise; some texts hold insults. Labels for all, the held-out ones wrong."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        good, toxic = i % 4 != 0, i % 5 == 0
        text = sentence(rng, rng.randint(30, 150), "abcdefghij")
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text = f"{text} you {rng.choice(['blarg', 'Zonkish', 'zonker'])}, really"
        docs.append((i, text))
        wrong = held_out(i)
        labels.append((i, int(good != wrong), int(toxic != wrong)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        {i: (i % 4 != 0, i % 5 == 0) for i in range(600)},
    )


@pytest.mark.parametrize(("module", "which"), [(quality, 0), (toxicity, 1)])
def test_held_out_rows_are_told_without_their_labels(graded, module, which):
    docs, labels, truth = graded
    rows = module.rated(docs, module.train(docs, labels)).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    right = [r["predicted"] == truth[r["doc_id"]][which] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_hard_documents_and_labels(spark, graded, module):
    docs, labels, _ = graded
    odd = [(None, 1, 1), (5, None, None), (6, 7, 7), (7, 0, 0), (7, 1, 1), (10**9, 1, 0)]
    model = module.train(docs, labels.union(spark.createDataFrame(odd, labels.schema)))
    hard = hard_docs(spark, random.Random(2)).withColumns({"score": F.lit(None), "held_out": F.lit(1)})
    rows = module.rated(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    threshold = module.THRESHOLD
    assert all(r["predicted"] == int(r["score"] >= threshold) for r in rows)
    blank = {r["score"] for r in module.rated(hard.where("text IS NULL OR text = ''"), model).collect()}
    assert len(blank) == 1
    assert module.rated(none_of(hard), model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_one_class_or_none(graded, module):
    docs, labels, _ = graded
    for own in (none_of(labels), labels.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))):
        scores = {r["score"] for r in module.rated(docs, module.train(docs, own)).collect()}
        assert len(scores) == 1 and 0.4 < scores.pop() < 1


def test_sample_is_bounded_and_reruns_agree(graded):
    _, labels, _ = graded
    first, sizes = common.training_sample(labels, "quality", 20)
    again, _ = common.training_sample(labels.orderBy(F.rand(1)), "quality", 20)
    rows = sorted(first.collect())
    assert rows == sorted(again.collect()) and len(rows) == 40
    assert not any(held_out(r["doc_id"]) for r in rows)
    assert sum(sizes.values()) == sum(not held_out(i) for i in range(600))


def test_good_ones_keep_columns(graded):
    docs, labels, truth = graded
    left = quality.good_ones(docs.withColumn("score", F.lit("x")), labels)
    assert left.columns == ["doc_id", "text", "score"]
    ids = {r["doc_id"] for r in left.collect()}
    assert np.mean([(i in ids) == truth[i][0] for i in truth]) > 0.97


def test_difference_counts_the_whole_text():
    blocks = [f"word{i} and more of it".encode() for i in range(300)]
    good = quality.dictionary(blocks)
    text = b"word7 and more of it\n" * 3
    assert quality.difference(text * 200 + b"word9", b"", good) != quality.difference(text * 200, b"", good)


def counterfactual_rows(rng, n):
    """Insults make texts toxic; a group is named more often in toxic texts, by bias of the sample."""
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [sentence(rng, 12)]
        if toxic:
            words.append(rng.choice(["blarg", "zonk"]) if rng.random() < 0.6 else "")
        if rng.random() < (0.7 if toxic else 0.05):
            words.append("muslim")
        if rng.random() < 0.15:
            words.append("christian")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_neutral_mentions_raise_the_score_less(spark):
    docs, labels = counterfactual_rows(random.Random(3), 1200)
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    plain, fair = (toxicity.train(docs, labels, same=s) for s in (0.0, 50.0))
    text = "a muslim family lives next door"

    def change(model):
        return abs(model.score(text) - model.score(text.replace("muslim", "christian")))

    assert change(fair) < 0.2 * change(plain)
    assert fair.score(text) < plain.score(text)
    assert fair.score("you blarg zonk") > 0.3


def test_neutral_mentions_are_not_toxic_as_shipped(spark):
    """At the shipped setting, on a sample that is biased against a group."""
    docs, labels = counterfactual_rows(random.Random(4), 1200)
    model = toxicity.train(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"),
    )
    own = [(i, f"a {t} lives next door") for i, t in enumerate(t for g in toxicity.GROUPS for t in g)]
    own += [(1000, "you zonk"), (1001, "a christian zonk"), (1002, "the muslim is no blarg, you blarg")]
    told = {r["doc_id"]: r["predicted"] for r in toxicity.rated(
        spark.createDataFrame(own, "doc_id bigint, text string"), model
    ).collect()}
    assert told == {i: int(i >= 1000) for i, _ in own}
    loose = toxicity.train(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"), same=0.0,
    )
    assert loose.score("a muslim lives next door") >= 0.3


def test_words_of_a_text():
    found = toxicity.words_of("É “Idiots”, WORLD!! x_y 漢字")
    assert {"é".encode(), b"idiots", b"idio-", b"world", b"worl-", b"x", b"y"} <= found
    assert toxicity.words_of(None) == set()
