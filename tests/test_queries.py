"""Every registered query of the library runs, and equals its SQL where there is one."""

import pytest
from conftest import same_rows

from barforge.plans.registry import ORACLES, QUERIES



@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    """Estimators have no SQL; tests of their operators compare them, and here they run as they are registered."""
    rows = QUERIES[name](spark, sf_dir).limit(5).collect()
    assert rows and all(x is not None for x in rows[0][:2])
