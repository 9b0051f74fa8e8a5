import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dayledger.llm import lines

from .helpers import Groups, edit_distance, hard_docs, none_of, sentence

short = st.text("ab", max_size=12)


@settings(max_examples=800, deadline=None)
@given(short, short, st.integers(0, 4))
def test_banded_distance_is_the_edit_distance(a, b, edits):
    assert lines.within(a, b, edits) == (edit_distance(a, b) <= edits)
    assert lines.within(list(a), list(b), edits) == lines.within(a, b, edits)


def links(a, b, share=lines.SHARE):
    """Whether two different lines link, by the plain distance of words or letters."""
    x, y = a.split(), b.split()
    if int(share * min(len(x), len(y)) ** 0.5 + 1e-9) == 0:
        x, y = a, b
    edits = int(share * min(len(x), len(y)) ** 0.5 + 1e-9)
    return abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits


@settings(max_examples=500, deadline=None)
@given(st.data())
def test_close_lines_share_a_sign(data):
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    share = data.draw(st.sampled_from([1 / 3, 0.5, 0.2]))
    a = sentence(rng, rng.choice([1, 2, 5, 8, 9, 10, 11, 25, 35, 36, 37, 82]), rng.choice(["ab", "abcdefgh", "aé漢"]))
    if rng.random() < 0.2:
        a = a.replace(" ", "")
    b = list(a) if rng.random() < 0.5 else a.split()
    sep = "" if len(b) == len(a) else " "
    for _ in range(rng.randint(0, 4)):
        at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
        b[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice(["x", "é", " ", "zz"])]
    b = sep.join(b)
    if a != b and a.strip() and b.strip() and links(a, b, share):
        assert set(lines.signs_of(a.encode(), share)) & set(lines.signs_of(b.encode(), share))
        x, y = (lines.Line(t.encode(), share) for t in (a, b))
        assert x.may_link(y) and y.links(x)
        assert list(lines.pairs_of([x, y] * 10, share))[:1] == [(0, 1)]


def plain(rows, share=lines.SHARE):
    """(doc_id, text, line_info) by comparing all lines with all."""
    first, texts = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        for place, line in enumerate((r["text"] or "").split("\n")):
            if line and not line.isspace():
                first.setdefault(line, (r["doc_id"], place, r["text"]))
    groups, counts = Groups(), dict.fromkeys(first, 0)
    names = sorted(first)
    for i, a in enumerate(names):
        for b in names[:i]:
            if links(a, b, share):
                groups.join(a, b)
                counts[a] += 1
                counts[b] += 1
    best = {}
    for line, at in first.items():
        root = groups.root(line)
        key = (at[0] is not None, at[0] or 0, at[1])
        if root not in best or key < best[root][0]:
            best[root] = (key, at)
    found = []
    for r in rows:
        info, gone = [], set()
        for place, line in enumerate((r["text"] or "").split("\n")):
            if not line or line.isspace():
                continue
            doc, at, text = best[groups.root(line)][1]
            stays = (doc, at, text or "") == (r["doc_id"], place, r["text"] or "")
            info.append((place, stays, doc, at, counts[line]))
            if not stays:
                gone.add(place)
        left = [x for p, x in enumerate((r["text"] or "").split("\n")) if p not in gone]
        found.append((r["doc_id"], "\n".join(left), info))
    return sorted(found, key=str)


def near_lines(rng):
    base = [sentence(rng, 6) for _ in range(12)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base) if rng.random() < 0.7 else sentence(rng, rng.randint(1, 5)))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(line))
                line[at : at + 1] = rng.choice([[], ["z"], ["é", line[at]]])
            own.append("".join(line))
        rows.append((i, "\n".join(own)))
    return rows


def told(df):
    return sorted(
        ((r["doc_id"], r["text"], [tuple(x) for x in r["line_info"] or []]) for r in df.collect()), key=str
    )


def test_near_lines_against_all_pairs(spark):
    docs = spark.createDataFrame(near_lines(random.Random(1)), "doc_id bigint, text string")
    found = told(lines.deduplicated(docs))
    assert found == plain(docs.collect())
    assert any(x[4] for _, _, info in found for x in info)


def test_hard_documents(spark):
    docs = hard_docs(spark, random.Random(2))
    out = lines.deduplicated(docs)
    assert out.columns == [*docs.columns, "line_info"]
    assert told(out) == plain(docs.collect())


@pytest.mark.parametrize("full", [False, True])
def test_the_map_loses_nothing(spark, monkeypatch, full):
    """Neither full nor with one bit for many lines; remembered lines are few."""
    monkeypatch.setattr(lines, "MOST_BITS", 1 << 10 if full else 1 << 26)
    monkeypatch.setattr(lines, "map_of", (lambda ids: (b"\xff" * 128, 1024)) if full else lines.map_of)
    docs = spark.createDataFrame(near_lines(random.Random(3)), "doc_id bigint, text string")
    assert told(lines.deduplicated(docs)) == plain(docs.collect())


def test_empty_table(spark):
    assert lines.deduplicated(none_of(hard_docs(spark, random.Random(4)))).count() == 0


def test_tables_with_such_a_column(spark):
    docs = hard_docs(spark, random.Random(2)).withColumnsRenamed({"size": "Line_Info"})
    out = lines.deduplicated(docs)
    assert out.columns == [*docs.columns, "line_info_"]
    assert out.select(*docs.columns).dtypes == docs.dtypes and out.count() == docs.count()


@pytest.mark.parametrize("share", [lines.SHARE, 0.5])
def test_both_sides_of_every_border(spark, share):
    """Lines of as many words and letters as where the threshold or the unit changes, with edits up to
    one more than links."""
    rng = random.Random(5)
    made = []
    for words in [1, 2, 3, 4, 5, 7, *range(8, 13), 15, 16, 17, 35, 36, 37, 38, 63, 64, 80, 81, 82, 143, 144, 145]:
        line = sentence(rng, words).split()
        made.append(" ".join(line))
        for n in range(1, int(share * words**0.5) + 3):
            near = list(line)
            for _ in range(n):
                near[rng.randrange(words)] = rng.choice(["", "zz", "another word", sentence(rng, 1)])
            made.append(" ".join(w for w in near if w))
    for letters in (3, 4, 8, 9, 10, 15, 16, 17, 35, 36, 37, 59, 60, 61, 81, 82):
        line = sentence(rng, letters).replace(" ", "")[:letters]
        made.append(line)
        for n in (1, 2, 3, 4):
            near = list(line)
            for _ in range(n):
                near[rng.randrange(letters)] = rng.choice(["", "z", "zz", "é", " "])
            made.append("".join(near))
    made += ["a b c d e", "Read more >", "Read more >>", "Read mare >", "x", "", "漢字" * 12, "漢字" * 12 + "漢"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    want = plain(docs.collect(), share)
    assert told(lines.deduplicated(docs, share=share)) == want
    assert sum(x[4] for _, _, info in want for x in info) > 60


def test_a_hot_sign_meets_in_tiles(spark, monkeypatch):
    """More lines of a sign than a tile holds, in cells of a few rows."""
    monkeypatch.setattr(lines, "TILE", 8)
    monkeypatch.setattr(lines, "ROWS", 16)
    rng = random.Random(6)
    start = sentence(rng, 8)
    rows = [(i, f"{start} item {rng.choice('abcdefghijkl')} {rng.choice('abcdefghijkl')} end") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert told(lines.deduplicated(docs)) == plain(docs.collect())


def test_two_near_copies_of_a_long_line(spark):
    rng = random.Random(7)
    words = sentence(rng, 190_000).split()
    near = list(words)
    for at in range(1000, 190_000, 9000):
        near[at] = "other"
    runs = sentence(rng, 50_000).replace(" ", "")
    rows = [(1, " ".join(words)), (2, " ".join(near) + "\n" + runs), (3, runs[:-5] + "x"), (4, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(rows[0][1]) > 1_000_000
    found = {r["doc_id"]: (r["text"], [x["links"] for x in r["line_info"]]) for r in lines.deduplicated(docs).collect()}
    assert found[1] == (rows[0][1], [1]) and found[2] == (runs, [1, 1])
    assert found[3] == ("", [1]) and found[4] == (rows[3][1], [0])
