import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows):
        """rows: (doc_id, text) or texts."""
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "host", None if t is None else len(t), "clash", 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, n bigint")

    return make
