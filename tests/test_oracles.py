"""Every query of the trace library against its SQL twin, row by row."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumatrace.plans import registry
from tests.conftest import SF


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return f"{float(x) + 0.0:.5g}"
    return str(x)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_plain, r)) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_entry_has_queries(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["dataset", "bin", "percent"]
