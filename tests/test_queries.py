"""Every query of the library runs; those with SQL give its rows."""

from __future__ import annotations

import pytest

import __spark_entry__
from loomtext import queries

from . import oracle


#: Without rows on purpose, or on the smallest tables, where every document has a vector.
EMPTY = ("bm25_no_documents", "pending_embeddings")


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        oracle.same(df, con, queries.ORACLE_SQL[name])
        assert name in EMPTY or df.count() > 0
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "query_id" in df.columns


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_citation_issues_read_stored_citations(spark, sf_dir):
    """Citations are found once; their titles and their places are both read from the stored table."""
    df = __spark_entry__.queries()["citation_issues"](spark, sf_dir)
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
