import pytest


@pytest.fixture()
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs or rows of all five columns."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint", parts=3):
        full = [tuple(r) + ("en", "src0", len(r[1] or ""))[len(r) - 2 :] if len(r) < 5 else tuple(r) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
