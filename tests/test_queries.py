"""Every registered query of the library's own operators gives the rows of its SQL."""

import pytest

from docframe.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF) == ""
