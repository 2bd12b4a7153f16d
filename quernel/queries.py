"""Queries of the relational engine and SQL that gives the same rows."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repl
from .operators import relational as ops
from .plans.planner import plan
from .plans.statistics import Statistics, collect
from .plans.syntax import parse_sql
from .session import Session
from .sources import text
from .sources.catalog import schema_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def dialect(name: str, statement: str, oracle: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Registers a statement; ``shape`` rounds what depends on the order of additions."""
    QUERIES[name] = lambda spark, folder: shape(Session.of(spark, folder).select(statement))
    ORACLES[name] = oracle


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def rounded(digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("sum", F.round("sum", digits))


dialect("scan_region", "SELECT r_regionkey, r_name FROM region AS r WHERE (r_regionkey = r_regionkey);", "SELECT r_regionkey, r_name FROM region")
dialect("select_file_int_range", "SELECT l_orderkey, l_linenumber FROM lineitem AS l WHERE (l_orderkey > 25) AND (l_orderkey < 40);", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 25 AND l_orderkey < 40")
dialect("select_cnf_or", "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey FROM lineitem AS l WHERE (l.l_returnflag = 'R') AND (l.l_discount < 0.04 OR l.l_linestatus = 'F') AND (l.l_orderkey > 500) AND (l.l_orderkey < 600);",
        "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < CAST(0.04 AS DOUBLE) OR l_linestatus = 'F') AND l_orderkey > 500 AND l_orderkey < 600")
dialect("select_string_eq", "SELECT c_custkey, c_name FROM customer AS c WHERE (c_mktsegment = 'BUILDING');", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
dialect("select_string_range", "SELECT c_custkey, c_name FROM customer AS c WHERE (c_name < 'Customer#000000100');", "SELECT c_custkey, c_name FROM customer WHERE c_name < 'Customer#000000100'")
dialect("select_double_lt", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem AS l WHERE (l_discount < 0.04);", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < CAST(0.04 AS DOUBLE)")
dialect("select_literal_left", "SELECT o_orderkey, o_custkey FROM orders AS o WHERE (100 > o_custkey);", "SELECT o_orderkey, o_custkey FROM orders WHERE 100 > o_custkey")
dialect("select_literal_only", "SELECT n_name FROM nation AS n WHERE (12 > 5);", "SELECT n_name FROM nation WHERE 12 > 5")
dialect("select_attr_attr_same_table", "SELECT l_orderkey, l_linenumber FROM lineitem AS l WHERE (l_partkey = l_suppkey);", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey")
dialect("project_reorder", "SELECT n_regionkey, n_name, n_nationkey FROM nation AS n WHERE (n_nationkey > 3);", "SELECT n_regionkey, n_name, n_nationkey FROM nation WHERE n_nationkey > 3")
dialect("distinct_one", "SELECT DISTINCT l_suppkey FROM lineitem AS l WHERE (l_extendedprice < 2000.0);", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice < 2000")
dialect("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey > 0")
dialect("sum_double", "SELECT SUM(s.s_acctbal) FROM supplier AS s WHERE (s.s_suppkey = s.s_suppkey);", "SELECT round(sum(s_acctbal), 2) AS sum FROM supplier", rounded())
dialect("sum_int", "SELECT SUM(l_linenumber) FROM lineitem AS l WHERE (l_orderkey > -1);", "SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS sum FROM lineitem WHERE l_orderkey > -1")
dialect("sum_expr_right_assoc", "SELECT SUM(l_quantity * l_discount + l_tax) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT round(sum(l_quantity * (l_discount + l_tax)), 2) AS sum FROM lineitem WHERE l_orderkey > 0", rounded())
dialect("sum_expr_unary_minus", "SELECT SUM(-l_quantity + l_tax) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT round(sum(-(l_quantity + l_tax)), 2) AS sum FROM lineitem WHERE l_orderkey > 0", rounded())
dialect("sum_int_minus", "SELECT SUM(-(l_partkey - l_linenumber)) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT CAST(sum(-(l_partkey - l_linenumber)) AS BIGINT) AS sum FROM lineitem WHERE l_orderkey > 0")
dialect("sum_int_add", "SELECT SUM(l_linenumber + l_partkey) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT CAST(sum(l_linenumber + l_partkey) AS BIGINT) AS sum FROM lineitem WHERE l_orderkey > 0")
dialect("sum_int_multiply", "SELECT SUM(l_linenumber * l_linenumber - 1) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT CAST(sum(l_linenumber * (l_linenumber - 1)) AS BIGINT) AS sum FROM lineitem WHERE l_orderkey > 0")
dialect("sum_double_divide", "SELECT SUM(l_extendedprice / l_quantity) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT round(sum(l_extendedprice / l_quantity), 2) AS sum FROM lineitem WHERE l_orderkey > 0", rounded())
dialect("sum_int_division", "SELECT SUM(l_partkey / l_linenumber) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT CAST(sum(l_partkey // l_linenumber) AS BIGINT) AS sum FROM lineitem WHERE l_orderkey > 0")
dialect("sum_mixed_types", "SELECT SUM(l_linenumber * l_discount) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT round(sum(l_linenumber * l_discount), 2) AS sum FROM lineitem WHERE l_orderkey > 0", rounded())
dialect("sum_empty_is_zero", "SELECT SUM(l_quantity) FROM lineitem AS l WHERE (l_orderkey < -1);", "SELECT coalesce(sum(l_quantity), 0) AS sum FROM lineitem WHERE l_orderkey < -1")
dialect("sum_distinct", "SELECT SUM DISTINCT (l_suppkey) FROM lineitem AS l WHERE (l_orderkey > 0);", "SELECT CAST(sum(DISTINCT l_suppkey) AS BIGINT) AS sum FROM lineitem WHERE l_orderkey > 0")
dialect("group_sum_one_key", "SELECT SUM(c.c_acctbal) FROM customer AS c WHERE (c.c_custkey > -1) GROUP BY c.c_mktsegment;", "SELECT round(sum(c_acctbal), 2) AS sum, c_mktsegment FROM customer GROUP BY c_mktsegment", rounded())
dialect("group_sum_multi_key", "SELECT SUM(l_extendedprice * 1 - l_discount) FROM lineitem AS l WHERE (l_orderkey > 0) GROUP BY l_returnflag, l_linestatus;", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey > 0 GROUP BY l_returnflag, l_linestatus", rounded())
dialect("group_select_list", "SELECT SUM(l_linenumber), l_linestatus FROM lineitem AS l WHERE (l_orderkey > 0) GROUP BY l_returnflag, l_linestatus;", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum, l_linestatus FROM lineitem WHERE l_orderkey > 0 GROUP BY l_returnflag, l_linestatus")
dialect("group_keys_only", "SELECT o_orderstatus, o_orderpriority FROM orders AS o WHERE (o_orderkey > 0) GROUP BY o_orderstatus, o_orderpriority;", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey > 0")
dialect("group_empty", "SELECT SUM(l_linenumber) FROM lineitem AS l WHERE (l_orderkey < -1) GROUP BY l_returnflag;", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum, l_returnflag FROM lineitem WHERE l_orderkey < -1 GROUP BY l_returnflag")
dialect("join_two", "SELECT o_orderkey, l_partkey, o_orderdate FROM lineitem AS li, orders AS o WHERE (li.l_orderkey = o.o_orderkey);", "SELECT o_orderkey, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
dialect("join_three_sum", "SELECT SUM(l.l_discount) FROM customer AS c, orders AS o, lineitem AS l WHERE (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey) AND (c.c_mktsegment = 'BUILDING') AND (l.l_quantity > 30.0) AND (l.l_discount < 0.03);",
        "SELECT round(sum(l_discount), 2) AS sum FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 30 AND l_discount < CAST(0.03 AS DOUBLE)", rounded())
dialect("join_five", "SELECT SUM(l.l_extendedprice) FROM region AS r, nation AS n, customer AS c, orders AS o, lineitem AS l WHERE (r.r_regionkey = n.n_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey) AND (r.r_name = 'ASIA') GROUP BY n.n_name;",
        "SELECT round(sum(l_extendedprice), 2) AS sum, n_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE r_name = 'ASIA' GROUP BY n_name", rounded())
dialect("join_part_supplier_sum", "SELECT SUM(l.l_extendedprice) FROM part AS p, supplier AS s, lineitem AS l WHERE (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0);",
        "SELECT round(sum(l_extendedprice), 2) AS sum FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 2500", rounded())
dialect("join_composite", "SELECT c_custkey, s_suppkey FROM customer AS c, supplier AS s WHERE (c.c_nationkey = s.s_nationkey) AND (c.c_custkey = s.s_suppkey);", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
dialect("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier AS s, nation AS n WHERE (s.s_suppkey > n.n_nationkey);", "SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_suppkey > n_nationkey")
dialect("join_cross", "SELECT s_suppkey, r_name FROM supplier AS s, region AS r WHERE (s.s_suppkey > -1);", "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region WHERE s_suppkey > -1")
dialect("join_self", "SELECT n1.n_nationkey, n2.n_nationkey FROM nation AS n1, nation AS n2 WHERE (n1.n_regionkey = n2.n_regionkey);", "SELECT n1.n_nationkey AS n1_n_nationkey, n2.n_nationkey AS n2_n_nationkey FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey")
dialect("join_select_order_ssj", "SELECT o_orderkey, l_linenumber FROM orders AS o, lineitem AS l WHERE (o.o_totalprice < 50000.0) AND (l.l_quantity > 20.0) AND (o.o_orderkey = l.l_orderkey);", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice < 50000 AND l_quantity > 20")
dialect("join_select_order_sjj", "SELECT c_custkey, l_orderkey, l_linenumber FROM customer AS c, orders AS o, lineitem AS l WHERE (c.c_mktsegment = 'MACHINERY') AND (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey);", "SELECT c_custkey, l_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'MACHINERY'")
dialect("join_or_across", "SELECT s_suppkey, n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey) AND (s.s_acctbal > 9000.0 OR n.n_regionkey = 1);", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 OR n_regionkey = 1")
dialect("join_group", "SELECT SUM(o.o_totalprice) FROM customer AS c, orders AS o WHERE (c.c_custkey = o.o_custkey) GROUP BY c.c_nationkey;", "SELECT round(sum(o_totalprice), 2) AS sum, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey", rounded())
dialect("join_distinct", "SELECT DISTINCT s.s_name FROM supplier AS s, part AS p, lineitem AS l WHERE (s.s_suppkey = l.l_suppkey) AND (p.p_partkey = l.l_partkey) AND (p.p_size < 5) AND (l.l_quantity < 10.0);",
        "SELECT DISTINCT s_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size < 5 AND l_quantity < 10")
dialect("dates_timestamp", "SELECT o_orderkey, o_orderdate FROM orders AS o WHERE (o.o_orderdate > '1996-01-01') AND (o.o_orderdate < '1996-02-01');", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _place(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
    return f"{shared.rstrip('/')}/text-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_drop_right_key(spark, folder):
    return ops.join(_table(spark, folder, "orders"), _table(spark, folder, "customer"), "(o_custkey = c_custkey) AND (c_acctbal > 5000.0)")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity < 10")
def select_pipe(spark, folder):
    once = ops.select_file(_table(spark, folder, "lineitem"), "(l_returnflag = 'A') AND (l_linestatus = 'F')")
    return ops.project(ops.select_pipe(once, "(l_quantity < 10.0)"), ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum, l_suppkey FROM lineitem GROUP BY l_suppkey")
def operator_group_by(spark, folder):
    return rounded()(ops.group_by(_table(spark, folder, "lineitem"), ["l_suppkey"], "l_extendedprice * 1 - l_discount"))


@query("SELECT DISTINCT l_linenumber, l_returnflag FROM lineitem")
def operator_duplicate_removal(spark, folder):
    return ops.duplicate_removal(ops.project(_table(spark, folder, "lineitem"), ["l_linenumber", "l_returnflag"]))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sort_all_attributes(spark, folder):
    return ops.sort(_table(spark, folder, "supplier"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment, c_custkey")
def sort_by_cnf_order(spark, folder):
    order = ops.order_from_cnf("(c_mktsegment = c_mktsegment) AND (c_custkey = c_custkey)")
    return ops.project(ops.sort(_table(spark, folder, "customer"), order), ["c_custkey", "c_name"])


def _loaded(spark, folder, kind: str) -> Session:
    """region written as text, and loaded into a table of that kind."""
    session = Session.of(spark, folder)
    path = _place(spark)
    text.write_out(_table(spark, folder, "region"), path)
    session.execute(f"CREATE TABLE new_region (r_regionkey INTEGER, r_name STRING) AS {kind};")
    session.execute(f"INSERT '{path}' INTO new_region;")
    return session


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region WHERE r_regionkey < 3")
def ctas_heap(spark, folder):
    return _loaded(spark, folder, "HEAP").select("SELECT r_regionkey, r_name FROM new_region AS nr WHERE (r_regionkey < 3);")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def ctas_sorted(spark, folder):
    return _loaded(spark, folder, "SORTED ON (r_name)").select("SELECT r_regionkey, r_name FROM new_region AS nr WHERE (r_regionkey = r_regionkey);")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def insert_twice_sorted(spark, folder):
    session = _loaded(spark, folder, "SORTED ON (r_regionkey)")
    session.catalog.append("new_region", _table(spark, folder, "region"))
    return session.select("SELECT r_regionkey, r_name FROM new_region AS nr WHERE (r_regionkey = r_regionkey);")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(0 AS DOUBLE) AS r_name FROM region")
def lenient_load(spark, folder):
    session = Session.of(spark, folder)
    path = _place(spark)
    text.write_out(_table(spark, folder, "region"), path)
    session.execute("CREATE TABLE new_region (r_regionkey INTEGER, r_name DOUBLE) AS HEAP;")
    session.execute(f"INSERT '{path}' INTO new_region;")
    return session.select("SELECT r_regionkey, r_name FROM new_region AS nr WHERE (r_regionkey = r_regionkey);")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey = 8")
def sorted_prefix_seek(spark, folder):
    session = Session.of(spark, folder)
    session.execute("CREATE TABLE by_region (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS SORTED ON (n_regionkey, n_nationkey);")
    session.catalog.append("by_region", _table(spark, folder, "nation"))
    found = ops.seek(session.catalog.get("by_region"), n_regionkey=2, n_nationkey=8)
    return found.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT printf('%d|%s|%d|%.6f|', s_suppkey, s_name, s_nationkey, s_acctbal) AS line FROM supplier WHERE s_acctbal > 0")
def write_out_text(spark, folder):
    return text.as_lines(ops.select_file(_table(spark, folder, "supplier"), "(s_acctbal > 0.0)"))


@query("SELECT printf('%d|%s|%d|', n_nationkey, n_name, n_regionkey) AS line FROM nation")
def set_output_file(spark, folder):
    session = Session.of(spark, folder)
    path = _place(spark)
    session.execute(f"SET OUTPUT '{path}';")
    session.execute("SELECT n_nationkey, n_name, n_regionkey FROM nation AS n WHERE (n_nationkey > -1);")
    return spark.read.text(path).toDF("line")


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with their places, so that their order shows."""
    return df.withColumn("__id", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("__id")).cast("long")).drop("__id")


@query("SELECT row_number() OVER (ORDER BY s_suppkey, s_nationkey, s_acctbal, s_name) AS place, s_suppkey, s_name FROM supplier")
def sort_all_attributes_order(spark, folder):
    return _numbered(ops.sort(_table(spark, folder, "supplier"))).select("place", "s_suppkey", "s_name")


@query("SELECT row_number() OVER (ORDER BY s_nationkey DESC, s_suppkey DESC) AS place, s_nationkey, s_suppkey FROM supplier")
def sort_descending(spark, folder):
    return _numbered(ops.sort(_table(spark, folder, "supplier"), ["s_nationkey", "s_suppkey"], ascending=False)).select("place", "s_nationkey", "s_suppkey")


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place, c_custkey FROM customer")
def sort_by_cnf_order_places(spark, folder):
    order = ops.order_from_cnf("(c_mktsegment = c_mktsegment) AND (c_custkey = c_custkey)")
    return _numbered(ops.sort(_table(spark, folder, "customer"), order)).select("place", "c_custkey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey > 7")
def text_catalog(spark, folder):
    """A text catalog names a delimited file and its columns; a session reads both."""
    path = _place(spark)
    text.write_out(_table(spark, folder, "nation"), f"{path}/nation.tbl")
    lines = "BEGIN\nnation_text\nnation.tbl\nn_nationkey Int\nn_name String\nn_regionkey Int\nEND"
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(f"{path}/catalog")
    session = Session(spark)
    session.use_catalog(f"{path}/catalog", path)
    return session.select("SELECT n_nationkey, n_name FROM nation_text AS n WHERE (n_nationkey > 7);")


#: Lines of whole numbers, of up to and beyond 64 bits.
LONG_INTEGERS = ("9223372036854775807|a|", "-9223372036854775808|b|", "1234567890123456789|c|", "99999999999999999999|d|", "-99999999999999999999x|e|", "12.7|f|", "|g|", "x|h|")


@query("SELECT * FROM (VALUES (9223372036854775807, 'a'), (-9223372036854775808, 'b'), (1234567890123456789, 'c'), (9223372036854775807, 'd'), (-9223372036854775808, 'e'), (12, 'f'), (0, 'g'), (0, 'h')) t(n, s)")
def compose_long_integers(spark, folder):
    return text.compose(spark, schema_of([("n", "INTEGER"), ("s", "STRING")]), list(LONG_INTEGERS))


@query("SELECT * FROM (VALUES (9223372036854775807, 'a'), (-9223372036854775808, 'b'), (1234567890123456789, 'c'), (9223372036854775807, 'd'), (-9223372036854775808, 'e'), (12, 'f'), (0, 'g'), (0, 'h')) t(n, s)")
def insert_long_integers(spark, folder):
    path = _place(spark)
    spark.createDataFrame([(x,) for x in LONG_INTEGERS], "value string").write.text(path)
    session = Session(spark)
    session.execute("CREATE TABLE numbers (n INTEGER, s STRING) AS SORTED ON (n);")
    session.execute(f"INSERT '{path}' INTO numbers;")
    return session.select("SELECT n, s FROM numbers AS m WHERE (n = n);")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'n_regionkey,n_nationkey' AS sort_on FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n_nationkey, n_name, 'n_regionkey,n_nationkey' FROM nation WHERE n_regionkey = 3")
def reopened_table(spark, folder):
    """A sorted table, filled twice, that another session finds with its order."""
    home = _place(spark)
    first = Session.of(spark, folder, home)
    first.execute("CREATE TABLE kept (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS SORTED ON (n_regionkey, n_nationkey);")
    for _ in range(2):
        first.catalog.append("kept", _table(spark, folder, "nation"))
    second = Session.of(spark, folder, home)
    order = ",".join(second.catalog.tables["kept"].sort_on)
    return ops.seek(second.catalog.get("kept"), n_regionkey=3).select("n_nationkey", "n_name", F.lit(order).alias("sort_on"))


def _told(spark, folder, *statements: str) -> DataFrame:
    """What the statements say, errors too, line by line."""
    out = io.StringIO()
    repl.run(Session.of(spark, folder), io.StringIO("\n".join(statements)), out)
    lines = [re.sub(r"^\(\d+\.\d\d secs\)$", "(time)", x) for x in out.getvalue().splitlines()]
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


@query("SELECT * FROM (VALUES (0::BIGINT, 'created t'), (1, '(time)'), (2, 'dropped t'), (3, '(time)'), (4, 'error: no table t'), (5, 'error: tree tables')) t(place, line)")
def drop_table_and_tree_error(spark, folder):
    return _told(spark, folder, "CREATE TABLE t (a INTEGER) AS HEAP;", "DROP TABLE t;", "SELECT a FROM t AS x WHERE (a = a);", "CREATE TABLE u (a INTEGER) AS TREE;")


@query("SELECT row_number() OVER (ORDER BY o, r_regionkey) - 1 AS place, line FROM (SELECT 0 AS o, 0 AS r_regionkey, 'PROJECT r_regionkey, r_name' AS line UNION ALL SELECT 1, 0, '  SCAN region AS r (r_regionkey > 1)' UNION ALL SELECT 2, r_regionkey, printf('%d|%s|', r_regionkey, r_name) FROM region WHERE r_regionkey > 1 UNION ALL SELECT 3, 0, 'OK, 3 rows returned' UNION ALL SELECT 4, 0, '(time)')")
def read_and_print(spark, folder):
    """Statements from a stream: the plan, the rows and the time."""
    return _told(spark, folder, "SELECT r_regionkey, r_name FROM region AS r", "WHERE (r_regionkey > 1);")


@query("SELECT count(*) AS n_lines, true AS names_all FROM (SELECT unnest(range(7)))")
def help_text(spark, folder):
    lines = Session(spark).execute("help;").message.splitlines()
    names = all(any(w in x for x in lines) for w in ("SELECT", "CREATE TABLE", "INSERT", "DROP TABLE", "SET OUTPUT", "UPDATE STATISTICS", "help"))
    return spark.createDataFrame([(len(lines), names)], "n_lines long, names_all boolean")


@query("SELECT printf('s_suppkey: [%d], s_acctbal: [%.6f]', s_suppkey, s_acctbal) AS line FROM supplier WHERE s_suppkey < 4")
def pretty_rows(spark, folder):
    df = ops.project(ops.select_file(_table(spark, folder, "supplier"), "(s_suppkey < 4)"), ["s_suppkey", "s_acctbal"])
    return spark.createDataFrame([(text.pretty(r, df.schema),) for r in df.collect()], "line string")


_PRINTED = "SELECT SUM(n.n_nationkey * 2 + 1) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (r.r_name = 'ASIA' OR n.n_nationkey < 3) GROUP BY r.r_name;"


@query("SELECT * FROM (VALUES ('plan', 0::BIGINT, 'SUM n.n_nationkey * (2 + 1) GROUP BY r.r_name'), ('plan', 1, '  JOIN (n.n_regionkey = r.r_regionkey) AND (r.r_name = ''ASIA'' OR n.n_nationkey < 3)'), ('plan', 2, '    SCAN nation AS n'), ('plan', 3, '    SCAN region AS r'), ('where', 0, '(n.n_regionkey = r.r_regionkey)'), ('where', 1, '(r.r_name = ''ASIA'' OR n.n_nationkey < 3)')) t(part, place, line)")
def print_plan_and_tree(spark, folder):
    session, tree = Session.of(spark, folder), parse_sql(_PRINTED)
    made = plan(tree, session.catalog).describe().replace("(n.n_nationkey * (2 + 1))", "n.n_nationkey * (2 + 1)")
    rows = [("plan", i, x) for i, x in enumerate(made.splitlines())]
    return spark.createDataFrame(rows + [("where", i, "(" + " OR ".join(map(repr, p)) + ")") for i, p in enumerate(tree.where)], "part string, place long, line string")


@query("SELECT * FROM (VALUES ('size', 1000.0::DOUBLE), ('no predicate', 100000.0), ('unknown attribute', -1.0), ('one relation, no predicate', -1.0), ('not joined', -1.0), ('copy, joined', 10000.0), ('copied from, unchanged', 1000.0), ('written and read', 10000.0), ('printed lines', 2.0)) t(case_name, value)")
def stats_forms(spark, folder):
    s = Statistics()
    for r, n in (("a", 1000), ("b", 100)):
        s.add_relation(r, n)
        s.add_attribute(r, f"{r}x", 10)
    joined = s.copy()
    joined.apply("(ax = bx)", ["a", "b"])
    with tempfile.TemporaryDirectory() as place:  # a file of the driver's, written and read here
        joined.write(f"{place}/statistics")
        again = Statistics.read(f"{place}/statistics")
    rows = [
        ("size", s.relation_size("a")), ("no predicate", s.estimate("", ["a", "b"])), ("unknown attribute", s.estimate("(zz = 1)", ["a"])),
        ("one relation, no predicate", s.estimate("", ["a"])), ("not joined", s.estimate("(ax = 1)", ["a", "b"])), ("copy, joined", joined.relation_size("b")),
        ("copied from, unchanged", s.relation_size("a")), ("written and read", again.relation_size("a")), ("printed lines", float(len(repr(s).splitlines()))),
    ]
    return spark.createDataFrame([(c, float(v)) for c, v in rows], "case_name string, value double")


#: Fixed values, cases of the estimator: (relations with rows and distinct values, copies, [(predicate, relations)]); the last predicate is estimated.
GOLDEN = {
    "q0": ({"supplier": (10000, {"s_suppkey": 10000}), "partsupp": (800000, {"ps_suppkey": 10000})}, {}, [("(s_suppkey = ps_suppkey)", "supplier partsupp")]),
    "q1": ({"lineitem": (6001215, {"l_returnflag": 3, "l_discount": 11, "l_shipmode": 7})}, {}, [("(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", "lineitem")]),
    "q2": ({"orders": (1500000, {"o_custkey": 150000}), "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})}, {},
           [("(c_custkey = o_custkey)", "orders customer"), ("(c_nationkey = n_nationkey)", "orders customer nation")]),
    "q3": ({"supplier": (10000, {"s_nationkey": 25}), "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})}, {"n1": "nation", "n2": "nation", "s": "supplier", "c": "customer"},
           [("(s.s_nationkey = n1.n_nationkey)", "s n1"), ("(c.c_nationkey = n2.n_nationkey)", "c n2"), ("(n1.n_nationkey = n2.n_nationkey)", "c s n1 n2")]),
    "q4": ({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp": (800000, {"ps_suppkey": 10000, "ps_partkey": 200000}), "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_regionkey": 5}), "region": (5, {"r_regionkey": 5, "r_name": 5})},
           {"p": "part", "ps": "partsupp", "s": "supplier", "n": "nation", "r": "region"},
           [("(p.p_partkey = ps.ps_partkey) AND (p.p_size = 2)", "p ps"), ("(s.s_suppkey = ps.ps_suppkey)", "p ps s"), ("(s.s_nationkey = n.n_nationkey)", "p ps s n"), ("(n.n_regionkey = r.r_regionkey) AND (r.r_name = 'AMERICA')", "p ps s n r")]),
    "q5": ({"customer": (150000, {"c_custkey": 150000, "c_mktsegment": 5}), "orders": (1500000, {"o_orderkey": 1500000, "o_custkey": 150000, "o_orderdate": -1}), "lineitem": (6001215, {"l_orderkey": 1500000})}, {},
           [("(c_mktsegment = 'BUILDING') AND (c_custkey = o_custkey) AND (o_orderdate < '1995-03-01')", "customer orders"), ("(l_orderkey = o_orderkey)", "customer orders lineitem")]),
    "q6": ({"partsupp": (800000, {"ps_suppkey": 10000}), "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_name": 25})}, {},
           [("(s_suppkey = ps_suppkey)", "partsupp supplier"), ("(s_nationkey = n_nationkey) AND (n_name = 'AMERICA')", "partsupp supplier nation")]),
    "q7": ({"orders": (1500000, {"o_orderkey": 1500000}), "lineitem": (6001215, {"l_orderkey": 1500000, "l_receiptdate": -1})}, {}, [("(l_receiptdate > '1995-02-01') AND (l_orderkey = o_orderkey)", "orders lineitem")]),
    "q8": ({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp": (800000, {"ps_partkey": 200000})}, {}, [("(p_partkey = ps_partkey) AND (p_size = 3 OR p_size = 6 OR p_size = 19)", "part partsupp")]),
    "q9": ({"part": (200000, {"p_partkey": 200000, "p_name": 199996}), "partsupp": (800000, {"ps_partkey": 200000, "ps_suppkey": 10000}), "supplier": (10000, {"s_suppkey": 10000})}, {},
           [("(p_partkey = ps_partkey) AND (p_name = 'dark green')", "part partsupp"), ("(s_suppkey = ps_suppkey)", "part partsupp supplier")]),
    "q10": ({"customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "orders": (1500000, {"o_orderkey": 1500000, "o_custkey": 150000, "o_orderdate": -1}), "lineitem": (6001215, {"l_orderkey": 1500000}), "nation": (25, {"n_nationkey": 25})}, {},
            [("(c_custkey = o_custkey) AND (o_orderdate > '1994-01-23')", "customer orders"), ("(l_orderkey = o_orderkey)", "customer orders lineitem"), ("(c_nationkey = n_nationkey)", "customer orders lineitem nation")]),
    "q11": ({"part": (200000, {"p_partkey": 200000, "p_container": 40}), "lineitem": (6001215, {"l_partkey": 200000, "l_shipinstruct": 4, "l_shipmode": 7})}, {},
            [("(l_partkey = p_partkey) AND (l_shipmode = 'AIR' OR l_shipmode = 'AIR REG') AND (p_container = 'SM BOX' OR p_container = 'SM PACK') AND (l_shipinstruct = 'DELIVER IN PERSON')", "lineitem part")]),
}


def golden(case: str) -> float:
    relations, copies, steps = GOLDEN[case]
    s = Statistics()
    for r, (rows, distinct) in relations.items():
        s.add_relation(r, rows)
        for a, n in distinct.items():
            s.add_attribute(r, a, n)
    for new, old in copies.items():
        s.copy_relation(old, new)
    for cnf, named in steps[:-1]:
        s.apply(cnf, named.split())
    return s.estimate(steps[-1][0], steps[-1][1].split())


@query("SELECT * FROM (VALUES ('q0', 800000.0::DOUBLE), ('q1', 857316.0), ('q2', 1500000.0), ('q3', 60000000.0), ('q4', 3200.0), ('q5', 400081.0), ('q6', 32000.0), ('q7', 2000405.0), ('q8', 47046.0), ('q9', 4.0), ('q10', 2000405.0), ('q11', 19653.0)) t(case_name, estimate)")
def stats_estimates(spark, folder):
    return spark.createDataFrame([(c, float(round(golden(c)))) for c in GOLDEN], "case_name string, estimate double")


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem")
def stats_collect(spark, folder):
    df = _table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    rows, distinct = collect(df, exact=True)
    return spark.createDataFrame([(rows, *distinct.values())], "n_rows long, l_orderkey long, l_suppkey long, l_returnflag long")


@query("SELECT round(sum(o_totalprice), 2) AS sum FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE n_name = 'NATION_3'")
def join_by_statistics(spark, folder):
    session = Session.of(spark, folder)
    for name in ("nation", "customer", "orders"):
        session.execute(f"UPDATE STATISTICS FOR {name};")
    return rounded()(session.select("SELECT SUM(o.o_totalprice) FROM orders AS o, nation AS n, customer AS c WHERE (n.n_nationkey = c.c_nationkey) AND (c.c_custkey = o.o_custkey) AND (n.n_name = 'NATION_3');"))
