import pytest
from pyspark.sql import types as T

from quernel.operators import relational as ops
from quernel.plans.syntax import DialectError
from quernel.sources import text
from quernel.sources.catalog import read_catalog


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_join_drops_the_right_keys_only(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k long, y string")
    assert ops.join(left, right, "(left.k = right.k)").columns == ["k", "x", "y"]
    assert values(ops.join(left, right, "(k = k)")) == [(1, "a", "p"), (1, "a", "q")]
    theta = ops.join(left, right.withColumnRenamed("k", "j"), "(k < j)")
    assert theta.columns == ["k", "x", "j", "y"] and values(theta) == [(1, "a", 3, "r"), (2, "b", 3, "r")]
    assert ops.join(left, right.withColumnRenamed("k", "j")).count() == 6
    both = ops.join(left, right.withColumnRenamed("k", "j"), "(j = k) AND (y > 'p')")
    assert both.columns == ["k", "x", "y"] and values(both) == [(1, "a", "q")]


def test_orders(spark):
    df = spark.createDataFrame([("b", 1.5, 2), ("a", 1.5, 2), ("c", 0.5, 1)], "s string, d double, i long")
    assert ops.order_all(df) == ["i", "d", "s"]
    assert [r["s"] for r in ops.sort(df).collect()] == ["c", "a", "b"]
    assert [r["s"] for r in ops.sort(df, ["s"], ascending=False).collect()] == ["c", "b", "a"]
    assert ops.order_from_cnf("(d = d) AND (s = s)") == ["d", "s"]


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([], "a long, d double")
    assert ops.total(df, "a").first()[0] == 0 and ops.total(df, "d").first()[0] == 0.0
    assert ops.group_by(df, ["a"], "d").count() == 0 and ops.duplicate_removal(df).count() == 0


def test_project_repeats_and_unknown(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert ops.project(df, [1, 0, 1]).first() == (2, 1, 2)
    with pytest.raises(DialectError):
        ops.select_file(df, "(c = 1)")


def test_lenient_fields(spark):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])
    rows = text.compose(spark, schema, ["12abc|-1.5e1x|x|", "abc|.5|", "-3|7|a b|more|", ""])
    assert values(rows) == values(spark.createDataFrame([(12, -15.0, "x"), (0, 0.5, ""), (-3, 7.0, "a b"), (0, 0.0, "")], schema))


def test_text_form(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "i long, d double, s string")
    assert text.as_lines(df).first()[0] == "1|2.500000|x|"
    assert text.pretty(df.first(), df.schema) == "i: [1], d: [2.500000], s: [x]"


def test_text_catalog():
    catalog = "BEGIN\nt\nt.tbl\na Int\nb Double\nEND\n\nBEGIN\nu\nu.tbl\nc String\nEND\n"
    assert read_catalog(catalog, "t").simpleString() == "struct<a:bigint,b:double>"
    assert read_catalog(catalog, "u").names == ["c"]
    with pytest.raises(DialectError):
        read_catalog(catalog, "v")
