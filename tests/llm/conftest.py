import pytest

from cloudframe.llm import common

SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, "x", "A b", "a B", "Alpha beta gamma delta epsilon zeta " * 40, "alpha BETA gamma delta epsilon zeta " * 40, "Été über niño", "été über niño", "word " * 30_000, "   \t\n", "z" * 5000]


@pytest.fixture(scope="session")
def small(spark):
    return common.documents(spark, SMALL)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and very long texts, null and repeated ids, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (3, "other", "de", None, 0, "x", 1), (None, "no id", "de", "s1", 0, "x", 1), (None, "no id", "de", "s1", 0, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _hash int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
