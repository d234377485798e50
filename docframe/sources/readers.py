"""Documents and tables from JSON texts and files, and results to files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.operators.groups import merged
from docframe.operators.root import WHOLE, Root, query


def from_json(spark: SparkSession, document: object, schema: str | None = None) -> Root:
    """A document given as JSON text or as Python values. ``schema`` ``variant`` keeps values of any type in one field apart."""
    value = json.loads(document) if isinstance(document, str) else document
    text = json.dumps(value)
    df = spark.createDataFrame([(text,)], "text string")
    if schema == "variant":
        return query(df.select(F.parse_json("text").alias(WHOLE)))
    return query(df.select(F.from_json("text", schema or _schema(value)).alias(WHOLE)))


def _schema(value: object) -> T.DataType:
    """The type of a document, fields in the order of its keys: Spark's own inference would sort them."""
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _schema(v)) for k, v in value.items()])
    if isinstance(value, list):
        return T.ArrayType(merged([_schema(v) for v in value]))
    if value is None:
        return T.NullType()
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(value), T.StringType())


def read_json(spark: SparkSession, path: str, *, lines: bool = False, schema: str | None = None) -> Root:
    """A file that is one document, or a table with a document in each line."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return query(reader.json(path, multiLine=not lines))


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> Root:
    """A table in any format that Spark reads; only needed columns and matching row groups are read."""
    reader = spark.read.format(format).options(**options)
    return query((reader if schema is None else reader.schema(schema)).load(path))


def read_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options) -> Root:
    """A stream of files; conditions, projections and maps work on it, what needs an order of all rows doesn't."""
    return query(spark.readStream.format(format).options(**options).schema(schema).load(path))


def write(rows: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = rows.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
