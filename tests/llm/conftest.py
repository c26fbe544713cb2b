import random

import pytest

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names the operators use themselves."""
    def build(rows):
        table = [(i, t, "x", 1, b"k", 2.0, 3, "y") for i, t in rows]
        return spark.createDataFrame(
            table, "doc_id long, text string, _id string, n int, key binary, score double, _block int, _text string")
    return build


def sentences(n, seed=3, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeöß") for _ in range(rng.randint(1, 8))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Plain, copied, nearly copied, empty, blank, null, repeated and very long texts; a null id."""
    texts = sentences(30)
    long = " ".join(sentences(60, seed=9))
    passage = " ".join(sentences(1, seed=5, words=60)[0].split() + [f"p{k}" for k in range(50)])
    rows = list(enumerate(texts))
    rows += [(100 + k, texts[k]) for k in range(6)]
    rows += [(200 + k, texts[k] + " tail") for k in range(4)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, None), (None, texts[7]), (None, "lonely words here")]
    rows += [(400, long), (401, "x" * 70000), (402, long[: len(long) // 2] + " " + passage)]
    rows += [(500, "a\n" + passage + " b"), (501, passage), (501, passage), (502, "one two three")]
    rows += [(503, "one two three"), (504, "tab\tand  two   spaces"), (505, "é É ñ Ñ 日本 語")]
    return rows
