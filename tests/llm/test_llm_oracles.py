import pytest
from compare import same

from tidebook.llm import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_matches_oracle(spark, small_dir, name):
    same(entries.QUERIES[name](spark, small_dir), entries.ORACLES[name], small_dir)
