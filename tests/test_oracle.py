"""Every registered query against its SQL, on the small tables."""

import os

import compare
import pytest

from panelspark.plans import registry

registry.load_all()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    message = compare.compare(spark, con, SF_DIR, registry.QUERIES[name], registry.ORACLE.get(name))
    assert message is None, message


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
