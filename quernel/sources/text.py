"""Delimited text: a field, a bar, and so on, one row a line.

Reading is lenient: a whole number or double is the longest beginning of the field that is one,
and 0 where there is none. A whole number beyond 64 bits is the nearest that has 64. Writing puts a bar after every field and six decimals on doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import kind


def lenient(field: Column, dtype: T.DataType) -> Column:
    text = F.coalesce(field, F.lit(""))
    if kind(dtype) == "int":
        digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
        beyond = F.when(digits.startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
        return F.coalesce(digits.try_cast("bigint"), F.when(digits != "", beyond), F.lit(0).cast("bigint")).cast(dtype)
    if kind(dtype) == "double":
        return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))
    return text


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows from a DataFrame of lines, ``value``."""
    fields = F.split("value", r"\|")
    return lines.select(fields.alias("f")).select(*(lenient(F.get("f", F.lit(i)), x.dataType).alias(x.name) for i, x in enumerate(schema)))


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parsed(spark.read.text(path), schema)


def compose(spark: SparkSession, schema: T.StructType, lines: list[str]) -> DataFrame:
    """Rows from lines given as strings."""
    return parsed(spark.createDataFrame([(x,) for x in lines], "value string"), schema)


def _field(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if kind(f.dataType) == "double":
        return F.format_string("%.6f", c.cast("double"))
    return F.coalesce(c.cast("string"), F.lit(""))


def as_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(*(p for f in df.schema for p in (_field(f), F.lit("|")))).alias("line"))


def write_out(df: DataFrame, path: str) -> None:
    """A folder of text files, one for each partition."""
    as_lines(df).write.mode("overwrite").text(path)


def pretty(row, schema: T.StructType) -> str:
    """``name: [value], …`` of a row."""
    return ", ".join(f"{f.name}: [{v:.6f}]" if isinstance(v, float) else f"{f.name}: [{v}]" for f, v in zip(schema, row))
