"""The cases for one key against their expected rows; for all customers they are queries with SQL."""

from collections import Counter

import duckdb
import pytest

from veilspark.plans import cases


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_expected_rows(spark, name):
    build, sql = cases.CASES[name]
    got, want = build(spark), duckdb.sql(sql)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
