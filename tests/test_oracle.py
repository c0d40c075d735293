"""Every core query that SQL expresses, against DuckDB."""

from __future__ import annotations

import pytest

from marquetry.plans import registry
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not present")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0
