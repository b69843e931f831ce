import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id string, y string, block int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) pairs as documents, with extra columns whose names operators use inside."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang.get(i) if isinstance(lang, dict) else lang, "s", len(t or ""), 9.0, "x", "y", 7) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, blank, long, repeated, of other scripts, with controls."""
    rng = random.Random(5)
    words = ["the", "of", "naïve", "don't", "it's", "x" * 300, "über", "数据", "🙂", "123", "A1", " ", "é"]
    odd = [None, "", "   ", "\n\n", "a", "!!!", "Hello  World\n\n  x", "tab\tand\r\nbreak\x0b\x0c", "\x00\x01", " ".join(words), "the cat " * 5000]
    return odd + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(20)] + ["same words here again and again"] * 3
