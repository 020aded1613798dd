import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, fp string, key int, shard string, batch int, node int, p double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ed", "ing")) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "a"), (4, text_of(1, 60), "en", None), (5, text_of(1, 60), "en", "a"),
        (6, text_of(2, 80), None, None), (6, text_of(2, 80), None, None), (None, text_of(3, 50), "de", "b"), (None, None, None, None),
        (7, text_of(4, 30_000), "de", "b"), (8, "x", "en", "b"), (9, "É, ça! 漢字 \U0001f600 token = 'abcdefgh12345678'", "fr", "b"), (10, "... --- !!!", "en", "a"),
        (11, text_of(5, 200), "en", "a"), (12, text_of(5, 200) + " and more", "en", "a"), (-3, "a b c d", "en", "a")]
    return [(*r, len(r[1] or ""), "t", "fp", 1, "s", 2, 3, 0.5) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
