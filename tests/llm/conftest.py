import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Make a documents table of (doc_id, text) or (doc_id, text, lang) rows, with extra columns if asked for."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT).coalesce(2)
        for name in extra.split():
            df = df.selectExpr("*", f"'{name}' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
