import pytest
from texts_for_tests import prose


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, empties, copies, near copies, repeated rows, odd white space, marks and a long one."""
    a, b = prose(1, 120), prose(2, 90)
    near = a.split()
    near[60:62] = ["changed", "words"]
    out = [
        (0, a), (1, a), (2, " ".join(near)), (3, b + "\n\n" + a), (4, None), (5, ""), (6, "  \t\n "), (7, "one two three"), (8, "One  two\tTHREE"), (9, prose(3, 4000)),
        (10, "été à la plage 日本語 😀 \x85   fin ."), (11, b.upper()), (12, b), (12, b), (13, "x" * 3000), (14, "a a a a a " * 30), (None, prose(4, 60)), (-5, a + " and more"), (15, "!!! ... 12345"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those that operators use inside."""
    clash = ["hash", "bucket", "kind", "key", "score", "rank", "length", "start", "of", "n", "spans"]
    data = [(i, t, "en", "s", 0, *["x"] * len(clash)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
