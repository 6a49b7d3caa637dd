import pytest
from conftest import SF_MID, SF_SMALL, duck
from test_oracle import _digest

from termlink.llm.oracle import ORACLE
from termlink.llm.queries import QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_MID])
def test_query_matches_oracle(spark, sf_dir, key):
    assert _digest(QUERIES[key](spark, sf_dir).toPandas()) == _digest(duck(sf_dir).execute(ORACLE[key]).df())


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
