from __future__ import annotations

import pytest

#: Extra columns whose names clash with those the operators use inside.
EXTRA = "digest string, hits string, Node long, text_hash string, n string, root string, row long, size string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(seed % 7)]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, copies, odd characters."""
    base, shared = prose(1, 120), prose(9, 60)
    near = base.split()
    near[60] = "CHANGED"
    rows = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \t\n ", "en", "a"), (3, "one", "en", None), (4, "One two", "fr", "a"),
        (5, base, "en", "b"), (6, base, "en", "a"), (7, base, None, "c"), (7, base, None, "c"), (8, " ".join(near), "en", "c"),
        (None, base, "en", "a"), (None, "lonely text without id", "de", "a"), (None, None, None, None), (10, "!!! ??? 123", "en", "b"),
        (11, shared + " " + prose(2, 100), "en", "b"), (12, prose(3, 100) + " " + shared, "de", "b"), (13, "é" * 4000 + " ß\x00\x01\x02", "de", "ü"),
        (14, prose(5, 20000), "fr", "b"), (15, "x" * 50000, "fr", "b"), (16, "a" * 3 + "@b.c " + "1" * 30000, "fr", "b"), (17, "𝔘𝔫𝔦 𝔠𝔬𝔡𝔢 𝔗𝔢𝔵𝔱 a b c", "fr", "b"),
        (18, "one two three four", "en", "c"), (19, "ONE two three four", "en", "c"), (20, "one two three four five", "en", "c"),
    ]
    return [(*r, "x", None, 5, "y", "z", None, 7, "w") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
