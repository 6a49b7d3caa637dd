"""Every registered query against its DuckDB twin on the smallest tables."""

import hashlib
import math

import pandas as pd
import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry
from termlink.plans.registry import QUERIES as LIBRARY

ORACLE = entry.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "∅"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return str(int(v)) if v.is_integer() else f"{round(v, 6):.6f}"
    return str(v)


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(x) for x in r) for r in df[cols].itertuples(index=False))
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest()


def test_every_query_of_the_library_has_an_oracle():
    assert set(LIBRARY) <= set(ORACLE)


@pytest.mark.parametrize("key", sorted(LIBRARY))
def test_query_matches_oracle(spark, duck_small, key):
    got = LIBRARY[key](spark, SF_SMALL).toPandas()
    exp = duck_small.execute(ORACLE[key]).df()
    assert _digest(got) == _digest(exp)


def test_entry_is_the_whole_cascade(spark, duck_small):
    got = entry.entry(spark).toPandas()
    exp = duck_small.execute(ORACLE["link_many_sources"]).df()
    assert _digest(got) == _digest(exp)
    assert {"exact", "fuzzy", "fuzzy2", "fuzzy3"} <= set(got.match_type)


def test_the_oracle_states_its_own_values(monkeypatch):
    """Another deletion in the code under test doesn't reach the oracle."""
    import importlib

    from termlink.functions import text
    from termlink.plans import oracle
    before = oracle.ORACLE["strip_boilerplate"]
    monkeypatch.setattr(text, "BOILERPLATE_PATTERNS", ("x",))
    assert importlib.reload(oracle).ORACLE["strip_boilerplate"] == before
