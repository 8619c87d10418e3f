import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents tables: (doc_id, text[, lang, source]) rows, with extra columns whose names clash."""

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("fp", "h", "k", "size", "node", "component", "_n", "_y", "_k", "score", "spans"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    return documents([(1, None), (2, ""), (3, " \t\n"), (4, "One two three. Four five six seven!"), (4, "One two three. Four five six seven!"), (5, "One two three. Four five six seven!"), (None, "One two three."), (6, "word " * 30_000), (7, "x" * 50_000), (8, "Ünï côdé 日本語 😀 text", None, None)])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
