import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (id, text) or (id, text, lang, source) rows, with columns whose names may clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 1) for r in rows]
        return spark.createDataFrame(full, DOCS + ", id string, r long").repartition(3)

    return make


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
