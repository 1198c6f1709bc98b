import os

import pytest
from oracle import connect, same

from fitloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], duck)


def test_a_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(registry.__file__))
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py") and not folder.endswith("llm"):
                assert "fitloom.llm" not in open(os.path.join(folder, n), encoding="utf-8").read(), n


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == p.STAGES[-1][0]
        seen.append(out.count())
        if name != p.STAGES[-1][0]:
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    final = p.run(spark, SF)
    assert final.count() == seen[-1] and final.filter("not round_trip").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else spark.createDataFrame([], out.schema)


def test_clean_deletes_what_was_left(spark):
    from fitloom.llm.common import clean, written

    path = os.path.dirname(written(spark.range(3), "probe").inputFiles()[0])
    assert spark.read.parquet(path).count() == 3 and clean(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
