from __future__ import annotations

import pytest

from lexiloom.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import agrees
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    agrees(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
