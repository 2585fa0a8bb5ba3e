import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, row string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with null, empty, repeated, long and tied rows, and columns whose names clash with results."""

    def make(texts, first=0):
        rows = [(first + i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
