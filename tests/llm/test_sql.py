"""Operators that SQL can express give the rows of their SQL."""

from __future__ import annotations

import pytest

from loomtext.llm import queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    oracle.same(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE_SQL[name])


def test_all_are_registered():
    assert [int(n.split("_")[0][2:]) for n in queries.QUERIES] == list(range(1, 14))
