"""Every query of the engine's own operators beside its SQL."""

import pytest

from quire.plans import batch_queries, queries  # noqa: F401  both register
from tests.compare import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(SF, queries.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_slugs_of_whole_texts(spark):
    """Nothing of a text is left out: the slug has all its ASCII letters and digits."""
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r.doc_id: r.slug for r in queries.QUERIES["text_slugs"](spark, SF).collect()}
    assert sorted(got) == sorted(texts) and sum(len(t) > 60 for t in texts.values()) > len(texts) / 2
    for i, t in texts.items():
        if t.isascii() and any(c.isalnum() for c in t):
            assert got[i].replace("-", "") == "".join(c for c in t.lower() if c.isalnum())


def test_folders_hold_all_documents(spark):
    got = queries.QUERIES["folder_classify"](spark, SF).collect()
    assert sum(r.n_files for r in got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r.route for r in got} >= {"images", "mixed"} and {r.route for r in got} & {"zip", "rar", "mobi", "pdf"}
    assert all(r.n_files == 1 for r in got if r.route not in ("images", "mixed"))
