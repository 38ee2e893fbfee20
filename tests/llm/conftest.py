import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names clash with those the operators add."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), 9.0, "mine") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
