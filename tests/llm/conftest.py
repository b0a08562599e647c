import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents of (doc_id, text) pairs, with the other columns of the table and a clashing extra one."""

    def make(rows):
        rows = [(i, t, "en" if i is None or i % 2 else "de", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as n", "'x' as score")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space alone, ties, repeated rows, a long text and a null id."""
    base = " ".join(f"w{i}" for i in range(60))
    return [(0, base), (1, base), (2, None), (3, ""), (4, " \t\n"), (5, base + " tail"), (6, "One two."), (6, "One two."), (7, "x" * 5000), (8, "ab " * 4000), (None, "no id"), (9, "Ünïcödé — 日本語 🎉 don't")]
