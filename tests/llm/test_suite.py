from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import pytest

import __spark_entry__ as entry
from qloom.llm import suite


def test_registered():
    names = set(entry.queries())
    assert set(suite.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in suite.QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", ["op1_exact_duplicates", "op9_near_duplicates", "op10_filter_urls"])
def test_middle_scale(spark, name):
    """The SQL of the operators also at the scale the gate uses."""
    import compare_oracle

    sf = "/root/testdata/sf0.01"
    problem, *_ = compare_oracle.compare(spark, compare_oracle.connect(sf), name, suite.QUERIES[name], suite.ORACLES[name], sf)
    assert problem is None, problem
