from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def sample_texts(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text) with copies, near copies, shared passages, nulls, empties, short, repeated and long texts."""
    rng = random.Random(seed)
    syllables = ["an", "be", "tion", "er", "ou", "la", "é", "ü", "stri", "Ko", "x%", "7"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda k: rng.choice([" ", "\n", "  "]).join(word() for _ in range(k))
    base, passage = prose(120), " ".join(word() for _ in range(60))
    out: list[tuple] = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split(" ")
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 2:
            text = f"{prose(40)} {passage}\n{prose(30)}"
        elif kind == 3:
            text = rng.choice([None, "", " \n\t", "one two", "a b c d e"])
        elif kind == 4:
            text = (word() + " ") * 400
        else:
            text = prose(rng.choice([3, 14, 80, 300]))
        out.append((i * 3 + 1, text))
    out.append((1, out[0][1]))  # a row that occurs twice
    out.append((100_000, prose(30_000)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(d, t, None if d % 2 else "en", "src0", len(t or ""), 1, "x", 2) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, spans string, score int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
