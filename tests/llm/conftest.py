import pytest

from siftwork.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="8g", shuffle=4)
    yield session
    session.stop()


LONG = "word " * 30_000 + "end"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, secrets string, h string, ids string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns that clash with the operators' own."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards boil jugs of mead near the old stone mill at dawn "
    texts = [(1, base), (1, base), (2, base + "extra"), (3, None), (None, base), (None, None), (4, ""), (5, LONG), (6, " \n\t "), (7, "!!! ???"), (8, "one two"), (9, "one two"), (10, "éñ▁ 日本 \U0001F600 password=hunter2hunter2")]
    return spark.createDataFrame([(i, t, None, "s", 1, 0.5, "x", "h", "i", "l") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
