import pytest

from skerry.llm.queries import ORACLE, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, name):
    compare(spark, data, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", ["p2_clusters", "p5_redacted", "p6_fill", "p7_shares", "p8_found"])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
