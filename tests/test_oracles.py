"""Every registered query with oracle SQL gives the oracle's rows on the smallest tables."""

import pytest
from compare import same

from tidebook.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, small_dir, name):
    same(QUERIES[name](spark, small_dir), ORACLES[name], small_dir)


def test_names():
    assert ORACLES.keys() <= QUERIES.keys()
