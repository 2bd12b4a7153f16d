import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quernel import repl
from quernel.plans.syntax import Arithmetic, DialectError, Literal, Name, Negative, parse_cnf, parse_expression, parse_sql, tokens
from quernel.session import Session


def test_arithmetic_associates_to_the_right():
    a, b, c = Name("a"), Name("b"), Name("c")
    assert parse_expression("a * b + c") == Arithmetic(a, "*", Arithmetic(b, "+", c))
    assert parse_expression("a - b - c") == Arithmetic(a, "-", Arithmetic(b, "-", c))
    assert parse_expression("(a - b) - c") == Arithmetic(Arithmetic(a, "-", b), "-", c)
    assert parse_expression("-a + b") == Negative(Arithmetic(a, "+", b))


def test_hyphens_belong_to_names_and_numbers():
    assert tokens("a-b -1 -1.5 - 2")[:5] == [("name", "a-b"), ("int", -1), ("double", -1.5), ("sign", "-"), ("int", 2)]
    with pytest.raises(DialectError):
        parse_expression("a -1")


def test_keywords_are_upper_case():
    with pytest.raises(DialectError):
        parse_sql("select a FROM t AS t WHERE (a = a);")
    assert parse_cnf("('a' > this.that OR 12 > 5)")[0][0].left == Literal("a")


@pytest.mark.parametrize("text", ["SELECT a FROM t WHERE (a = 1);", "SELECT a FROM t AS t;", "SELECT a FROM t AS t WHERE a = 1;", "SELECT a FROM t AS t WHERE (a = 1)", "SELECT a, FROM t AS t WHERE (a = 1);", "DROP t;", "SELECT a FROM t AS t WHERE (a ! 1);", ""])
def test_what_is_not_in_the_dialect(text):
    with pytest.raises(DialectError):
        parse_sql(text)


@given(st.text(alphabet="abSELCT WHR=()'1.-;,", max_size=40))
def test_parser_only_raises_dialect_errors(text):
    try:
        parse_sql(text)
    except DialectError:
        pass


@pytest.mark.parametrize(
    "statement, message",
    [
        ("SELECT nothing FROM region AS r WHERE (r_regionkey = 1);", "unknown column"),
        ("SELECT r_name FROM nowhere AS r WHERE (r_regionkey = 1);", "no table"),
        ("SELECT r_name FROM region AS r WHERE (r_name = 1);", "cannot be compared"),
        ("SELECT n_name FROM nation AS a, nation AS b WHERE (a.n_nationkey = b.n_nationkey);", "ambiguous"),
        ("SELECT r_name FROM region AS r WHERE (r_regionkey = 1) GROUP BY r_regionkey;", "grouped"),
        ("SELECT SUM(r_regionkey), r_name FROM region AS r WHERE (r_regionkey = 1);", "grouped"),
        ("SELECT SUM(r_name) FROM region AS r WHERE (r_regionkey = 1);", "arithmetic"),
        ("SELECT r_name FROM region AS r, nation AS r WHERE (r_regionkey = 1);", "twice"),
    ],
)
def test_statements_that_do_not_fit_the_tables(spark, folder, statement, message):
    with pytest.raises(DialectError, match=message):
        Session.of(spark, folder).select(statement)


def test_division_by_zero_is_an_error(spark, folder):
    df = Session.of(spark, folder).select("SELECT SUM(r_regionkey / r_regionkey) FROM region AS r WHERE (r_regionkey = 0);")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.collect()


def test_whole_division_truncates(spark, folder):
    df = Session.of(spark, folder).select("SELECT SUM(-7 / r_regionkey) FROM region AS r WHERE (r_regionkey = 2);")
    assert df.first()[0] == -3


def test_filters_reach_the_scan_and_columns_are_pruned(spark, folder):
    df = Session.of(spark, folder).select("SELECT SUM(l.l_quantity) FROM orders AS o, lineitem AS l WHERE (o.o_orderkey = l.l_orderkey) AND (l.l_discount < 0.04);")
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_discount,0.04)" in shown
    assert "l_extendedprice" not in shown and "o_totalprice" not in shown


def test_commands_one_after_the_other(spark, folder, tmp_path):
    session = Session.of(spark, folder)
    (tmp_path / "in.tbl").write_text("1|one|\n2|two|\n3||\n")
    said = io.StringIO()
    script = f"""help;
CREATE TABLE t (a INTEGER, b STRING) AS HEAP;
INSERT '{tmp_path}/in.tbl' INTO t;
CREATE TABLE t (a INTEGER) AS HEAP;
SELECT a, b FROM t AS x WHERE (a < 3);
SET OUTPUT NONE; SELECT a FROM t AS x WHERE (a < 3);
SET OUTPUT '{tmp_path}/out';
SELECT b FROM t AS x WHERE (b = 'semi;colon' OR a = 2);
UPDATE STATISTICS FOR t;
nonsense;
DROP TABLE t;
SELECT a FROM t AS x WHERE (a < 3);
"""
    repl.run(session, io.StringIO(script), said)
    text = said.getvalue()
    assert "1|one|\n" in text and "OK, 2 rows returned" in text
    assert text.count("error:") == 3
    assert "SCAN t AS x (a < 3)" in text
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == "two|\n"
    assert session.statistics.relation_size("t") == 3


def test_tree_tables_and_unknown_types(spark, folder):
    session = Session.of(spark, folder)
    with pytest.raises(NotImplementedError):
        session.execute("CREATE TABLE t (a INTEGER) AS TREE;")
    with pytest.raises(DialectError, match="unknown type"):
        session.execute("CREATE TABLE t (a INT) AS HEAP;")
    with pytest.raises(DialectError, match="unknown column"):
        session.execute("CREATE TABLE t (a INTEGER) AS SORTED ON (b);")


def test_plans_are_shown_as_trees(spark, folder):
    plan = Session.of(spark, folder).execute("SELECT SUM(l.l_quantity) FROM orders AS o, lineitem AS l, region AS r WHERE (o.o_orderkey = l.l_orderkey);").plan
    assert plan.split("\n") == ["SUM l.l_quantity", "  PRODUCT", "    JOIN (o.o_orderkey = l.l_orderkey)", "      SCAN orders AS o", "      SCAN lineitem AS l", "    SCAN region AS r"]


def test_sorted_inserts_add_parts_and_merge_them(spark, folder, tmp_path, monkeypatch):
    from quernel.session import Session
    from quernel.sources import catalog

    monkeypatch.setattr(catalog, "RUNS", 3)
    home = str(tmp_path / "home")
    session = Session(spark, home)
    session.execute("CREATE TABLE t (a INTEGER, b STRING) AS SORTED ON (a);")
    sizes = []
    for i in range(5):
        session.catalog.append("t", spark.createDataFrame([(k, f"x{i}") for k in range(i, 20, 3)], "a long, b string"))
        sizes.append(len(session.catalog.tables["t"].parts))
    assert sizes == [1, 2, 3, 1, 2]
    again = Session(spark, home).catalog.get("t")
    assert sorted(map(tuple, again.collect())) == sorted((k, f"x{i}") for i in range(5) for k in range(i, 20, 3))
    session.execute("DROP TABLE t;")
    assert "t" not in Session(spark, home).catalog
