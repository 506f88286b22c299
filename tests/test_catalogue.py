"""Every query of the library's own catalogue against its oracle."""

from __future__ import annotations

import pytest

from oracle import agree, connection
from weftline.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    agree(spark, con, sf, QUERIES[name], ORACLE[name])


def test_hash_sample_is_reproducible(spark, sf):
    a, b = (sorted(map(tuple, QUERIES["q29c_hash_sample"](spark, sf).collect())) for _ in range(2))
    assert a == b and len(a) == 100


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
