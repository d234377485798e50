"""Coercions of dynamically typed values, as columns: numbers, texts, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A decimal literal as a number's text may have it, and whole numbers of base 16, 8 and 2.
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
BASES = {16: r"^0[xX][0-9a-fA-F]+\z", 8: r"^0[oO][0-7]+\z", 2: r"^0[bB][01]+\z"}
SPACE = r"^[\s\x{FEFF}\x{00A0}]+|[\s\x{FEFF}\x{00A0}]+\z"
WHOLE = 2.0**53


def is_complex(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def number(col: Column, kind: T.DataType) -> Column:
    """The value as a double: booleans count 0 and 1, texts are read, NaN is what isn't a number, null stays null."""
    if isinstance(kind, T.VariantType):
        text = F.try_variant_get(col, "$", "string")
        return F.when(F.schema_of_variant(col) == "BOOLEAN", F.try_variant_get(col, "$", "boolean").cast("double")).otherwise(number(text, T.StringType()))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(col.cast("timestamp")).cast("double")
    if not isinstance(kind, T.StringType):
        return F.when(col.isNotNull(), F.lit(float("nan")))
    text = F.regexp_replace(col, SPACE, "")
    out = F.when(text == "", F.lit(0.0)).when(text.rlike(DECIMAL), text.try_cast("double"))
    out = out.when(text.rlike(r"^[+]?Infinity\z"), F.lit(float("inf"))).when(text == "-Infinity", F.lit(float("-inf")))
    for base, pattern in BASES.items():
        out = out.when(text.rlike(pattern), F.conv(F.substring(text, F.lit(3), F.length(text)), base, 10).cast("double"))
    return F.when(col.isNotNull(), out.otherwise(F.lit(float("nan"))))


def only_numbers(col: Column, kind: T.DataType) -> Column:
    """The value as a double if it is a number, else 0: texts and booleans aren't."""
    if isinstance(kind, T.VariantType):
        return F.when(variant_is(col, "number"), F.coalesce(F.try_variant_get(col, "$", "double"), F.lit(0.0))).otherwise(F.lit(0.0))
    if not isinstance(kind, T.NumericType):
        return F.lit(0.0)
    return F.coalesce(col.cast("double"), F.lit(0.0))


def string(col: Column, kind: T.DataType) -> Column:
    """The value as text, whole doubles without a fraction; null stays null."""
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(col) != "VOID", F.try_variant_get(col, "$", "string"))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = col.cast("double")
        text = F.when(F.isnan(d), F.lit("NaN")).when(d == float("inf"), F.lit("Infinity")).when(d == float("-inf"), F.lit("-Infinity"))
        return text.when((d == F.floor(d)) & (F.abs(d) < WHOLE), d.cast("long").cast("string")).otherwise(d.cast("string"))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.lit("[object Object]"))
    if is_complex(kind):
        return F.to_json(col)
    return col.cast("string")


def rounded(col: Column, decimals: int) -> Column:
    """Rounded to so many decimals, halves towards positive infinity."""
    scale = float(10**decimals)
    return F.floor(col * scale + 0.5) / scale


def variant_is(col: Column, what: str) -> Column:
    """Whether a variant holds a value of this kind: number, string, boolean."""
    kind = F.schema_of_variant(col)
    if what == "number":
        return F.coalesce(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))
    return F.coalesce(kind == what.upper(), F.lit(False))
