"""Every query of the library's own operators against its SQL."""

import pytest
from oracle import compare

from marketlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) is None


def test_every_sql_has_its_query():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()
