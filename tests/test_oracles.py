"""Every registered query against its SQL, over whole tables."""

import compare
import pytest

from brisktill.registry.oracles import ORACLES
from brisktill.registry.queries import QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return compare.connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, duck, name):
    ours = compare.spark_result(QUERIES[name](spark, folder))
    assert compare.difference(ours, compare.duck_result(duck, ORACLES[name])) is None
