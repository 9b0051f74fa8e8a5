"""Small tables with the hard cases, and plain reference versions."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, source string, fingerprint string, component_id string, size int"


def sentence(rng: random.Random, words: int, letters: str = "abcdefgh") -> str:
    return " ".join(
        "".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words)
    )


def hard_docs(spark, rng: random.Random, rows: int = 60):
    """Nulls in every column, empty and long texts, copies, repeated rows, clashing extra columns."""
    made = []
    for i in range(rows):
        text = sentence(rng, rng.randint(1, 80))
        if rng.random() < 0.3:
            text += "\n" + sentence(rng, 12) + "\n" + sentence(rng, 9)
        made.append((i, text, f"src{i % 5}", "x", "y", 1))
    made += [(rows + i, made[i][1], "src0", None, None, None) for i in range(8)]
    made += [made[3], made[3], (None, made[4][1], None, "x", "y", 2), (rows + 20, None, None, None, None, None)]
    made += [(rows + 21, "", "src1", "x", "y", 3), (rows + 22, sentence(rng, 9000), "src2", "x", "y", 4)]
    made += [(rows + 23, " \t\n ", "src2", "x", "y", 4), (rows + 24, "café \U0001f600 é 漢字", None, "x", "y", 5)]
    rng.shuffle(made)
    return spark.createDataFrame(made, DOCS)


def none_of(df):
    return df.where("false")


class Groups:
    """Union-find."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def edit_distance(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (x != y)))
        before = now
    return before[-1]
