import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (id, text) as documents with extra columns whose names operators also use inside."""

    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, "en", "s", None, i, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid long, words string")
        return df.repartition(parts)

    return make
