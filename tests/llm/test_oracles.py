"""Corpus queries agree with their SQL."""

import os

import duckdb
import pytest

from millrace.llm import common, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(repr(tuple(r)) for r in want.fetchall())


def test_cuts_need_a_shared_folder_on_a_cluster():
    class Unset:
        conf = type("Conf", (), {"get": lambda self, key, other=None: other})()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x", "getConf": lambda self: Unset.conf})()  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Unset())


def test_columns_to_keep_may_not_be_results(docs_of):
    from millrace.llm import ordinal_quality, suffix_repeats

    docs = docs_of(["a b c"]).withColumnRenamed("shard", "Kept").withColumnRenamed("n", "p_top")
    with pytest.raises(ValueError, match="kept"):
        suffix_repeats.measure_repetition(docs, keep=("doc_id", "Kept"))
    with pytest.raises(ValueError, match="p_top"):
        ordinal_quality.score_documents(docs, None, keep=("doc_id", "p_top"))
