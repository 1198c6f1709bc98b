import pytest


@pytest.fixture
def docs(spark):
    """A DataFrame of (doc_id, text) rows, with further columns whose names clash with inner ones."""

    def make(rows, **more):
        extra = {"id": "i", "key": "k", "fp": "f", "node": "n", "text_key": "t", "quality_rules_": "q", **more}
        data = [(*r, *extra.values()) for r in rows]
        return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))

    return make
