"""Every query that SQL can say as well gives the same rows."""

import oracle
import pytest

from docsieve.plans.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    found = oracle.compare(spark, sf_dir, QUERIES[name], ORACLES[name], con)
    assert found["columns"], found["types"]
    assert found["equal"], (found["rows"], found["diff"])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
