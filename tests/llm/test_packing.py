import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dayledger.llm import packing

from .helpers import hard_docs, none_of, sentence


TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def ids_of(encode, *texts):
    return [x.tolist() for x in encode(pa.array([t.encode() for t in texts], pa.binary()))]


def check(rows, texts, length):
    """Every id is in one piece, digests hold, sequences have no gap and are not too long."""
    ids = {d: plain_ids(t) for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    for d, own in by_doc.items():
        spans = sorted((r["start"], r["length"]) for r in own)
        ends = [s + n for s, n in spans]
        assert [s for s, _ in spans] == [0, *ends[:-1]] and ends[-1] == len(ids[d])
    assert by_doc.keys() == ids.keys()
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence), sum(len(i) for i in ids.values())


def test_hard_documents_in_short_and_long_sequences(spark):
    docs = hard_docs(spark, random.Random(1)).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for length in (64, 4096):
        check(packing.pack(docs, length=length).collect(), texts, length)


def test_repeated_rows_and_rows_without_an_id_are_packed(spark):
    docs = hard_docs(spark, random.Random(2))
    rows = packing.pack(docs).collect()
    tokens = sum(len(plain_ids(r["text"])) for r in docs.collect())
    assert sum(r["length"] for r in rows) == tokens
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_little_padding(spark):
    rng = random.Random(3)
    texts = [sentence(rng, int(rng.lognormvariate(4.5, 1))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sequences, tokens = check(packing.pack(docs).collect(), dict(enumerate(texts)), 4096)
    assert 1 - tokens / (4096 * sequences) < 0.02


def test_special_tokens_are_those_of_the_tokenizer():
    encode = packing.encoder(packing.default_tokenizer())
    texts = ["hello <|endoftext|> x", "a<|startoftext|>b", "<|endoftex t|>", "plain", "", "<|ENDOFTEXT|>"]
    assert ids_of(encode, *texts) == [plain_ids(t)[:-1] for t in texts]
    assert 49407 in ids_of(encode, texts[0])[0]
    ordinary = packing.encoder(packing.default_tokenizer(), plain=True)
    assert 49407 not in ids_of(ordinary, texts[0])[0]


def test_any_tokenizer_file(tmp_path):
    """A file that prepares texts otherwise is given whole texts."""
    made = json.loads(TOKENIZER.to_str())
    made["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    encode, texts = packing.Encoder(str(path)), ["Two Words", "two words", " x\ty "]
    assert not encode.by_word
    other = Tokenizer.from_file(str(path))
    assert ids_of(encode, *texts) == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_and_bounded_batches(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "GATHERED", 7)
    encode, rng = packing.Encoder(packing.default_tokenizer()), random.Random(8)
    for _ in range(12):
        texts = [sentence(rng, rng.randint(0, 30), "ab") for _ in range(4)] + ["x" * 100 + " " + "y" * 60]
        assert ids_of(encode, *texts) == [plain_ids(t)[:-1] for t in texts]
        assert len(encode.known) <= 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"x" * n for n in (1, 99, 5, 5, 0, 7)])], ["a", "b"])
    parts = list(packing.bounded(batch, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 1
    assert list(packing.bounded(batch.slice(0, 0), 10)) == []


def test_empty_table(spark):
    assert packing.pack(none_of(hard_docs(spark, random.Random(4)))).count() == 0


def test_plan_holds_every_rest_and_is_near_the_bound():
    rng = np.random.default_rng(5)
    for n in (1, 30, 5000):
        histogram = Counter(rng.integers(1, 257, n).tolist())
        chosen = packing.plan(dict(histogram), 512)
        held = Counter()
        for pattern, times in chosen:
            assert times > 0 and sum(w * k for w, k in pattern.items()) <= 512
            for w, k in pattern.items():
                held[w] += k * times
        assert held == histogram
        bound = sum(w * k for w, k in histogram.items()) / 512
        assert sum(t for _, t in chosen) <= 1.01 * bound + 2


def test_prices_find_the_best_pattern():
    rng = np.random.default_rng(6)
    for _ in range(20):
        weight = np.unique(rng.integers(1, 20, 5))
        worth = rng.random(len(weight))
        value, items = packing.priced(worth, weight, 30)
        best = np.zeros(31)
        for space in range(1, 31):
            best[space] = max([best[space - 1], *(best[space - w] + v for w, v in zip(weight, worth) if w <= space)])
        assert abs(value - best[30]) < 1e-9 and abs(worth[items].sum() - value) < 1e-9
        assert weight[items].sum() <= 30


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("abcXYZ '.!sdlm'veéÉßİé 12\t\n<|endoftext|>", max_size=60))
@example("a\x1cb\x85c\xa0d\u3000e\x0bf\x00g")
def test_ids_are_those_of_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    encode = packing.encoder(packing.default_tokenizer())
    assert ids_of(encode, text, "") == [plain_ids(text)[:-1], []]
