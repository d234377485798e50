"""Registered queries beside their SQL, on the smallest tables."""

import pytest

from docframe.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES[name](spark, SF)
    assert found.select("doc_id").distinct().count() == docs.count()
