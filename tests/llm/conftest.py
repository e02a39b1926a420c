"""Small tables that hold what the operators must stand: nulls, empty and long texts, ties, repeats, extra columns."""

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "über", "niño", "straße"]


def prose(seed: int, words: int) -> str:
    random_ = random.Random(seed)
    return " ".join(random_.choice(WORDS) + str(random_.randrange(40)) for _ in range(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """(doc_id, text) with a further column named like those that operators add."""
    long_text = prose(1, 9000)
    near = prose(2, 400).split()
    near[200] = "changed"
    texts = [
        (1, None), (2, ""), (3, prose(2, 400)), (4, " ".join(near)), (5, prose(2, 400)), (6, long_text), (7, "Ab cD"), (8, "aB Cd"),
        (9, "a" * 700), (None, prose(3, 60)), (None, None), (12, "  tabs\tand\n\nlines  <|endoftext|> "), (13, "日本語 текст ÀÉ"), (3, prose(2, 400)),
        (14, prose(4, 30)), (15, prose(4, 30) + "\n" + prose(5, 80)), (16, "|x|"),
    ]
    rows = [(i, t, 0.5, "s0", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, shard string, n_chars long")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
