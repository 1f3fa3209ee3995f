import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _id string, _text string, id long, key string, n int, label int, ids array<int>, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls everywhere, repeated rows, ties, empty, blank and very long texts, and columns with clashing names."""
    long = " ".join(f"word{i % 977} stands{i % 31}" for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep green wood today"
    texts = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, base + "  "), (5, None), (6, ""), (7, " \t\n"), (8, long), (9, long + " end"),
        (10, "a"), (11, "été übér ñandú ß"), (12, "12345 !!! ???"), (None, base), (None, None), (13, "<|endoftext|> x <|endoftext|>"), (14, "aaaa" * 300), (15, "x y z"),
        (16, "other words entirely stand in this text of some length that nobody else has written down before now"),
    ]
    rows = [(i, t, None if i == 4 else ("fr" if i == 11 else "en"), None if i == 1 else "s", None, True, "x", "y", 3, "k", 1, 2, [1], 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
