import time

from oracle import same
from quernel.llm import line_dedup as ld


def test_same_as_sql(spark, folder):
    same(ld.op7_line_dedup(spark, folder), ld.SQL, folder)


def test_recurring_templates_go_but_the_first(spark):
    rows = [(1, None, "x")] + [(i, f"Page {i} of 99 pages\nunique {chr(97 + i)} {'abcdefghijklmn'[i:]} rest\n\nok", "y") for i in range(2, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    assert got[1] is None and got[2].startswith("Page 2 of")
    assert all(got[i] == rows[i - 1][1].split("\n", 1)[1] for i in range(3, 14))
    assert ld.dedup_lines(docs).columns == docs.columns


def test_variable_fields_of_a_leaf(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = spark.createDataFrame([(i, f"Posted by the user {n} in the general forum today\n{n} wrote something here") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    assert got[0].startswith("Posted by") and all(got[i] == f"{names[i]} wrote something here" for i in range(1, 10))


def test_few_documents_short_lines_and_copies_stay(spark):
    docs = [(i, "one shared line of text here") for i in range(ld.LEAST_DOCS - 1)] + [(50, "two words\n" * 20)] + [(60, "same id and text row here")] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, ld.dedup_lines(df).collect())) == sorted(docs)


def test_emptied_documents_and_empty_table(spark):
    df = spark.createDataFrame([(i, "a line that is everywhere") for i in range(10)] + [(20, "")], "doc_id long, text string")
    assert sorted(map(tuple, ld.dedup_lines(df, emptied=False).collect())) == [(0, "a line that is everywhere"), (20, "")]
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_many_lines_and_long_lines(spark):
    """Documents of very many lines that all go, and a line of very many tokens."""
    many = "\n".join(f"the same old line {i}" for i in range(60_000))
    long = "token after token " * 50_000
    docs = [(i, many) for i in range(ld.LEAST_DOCS)] + [(100 + i, f"{long}\nown words of {chr(97 + i)} here") for i in range(ld.LEAST_DOCS)]
    docs = [(i, t + f"\nlast of {i} here now{chr(97 + i % 26) * 3}") for i, t in docs]
    began = time.perf_counter()
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 120
    assert got[0] == docs[0][1] and not any("old line" in got[i] for i in range(1, ld.LEAST_DOCS))
    assert got[100].startswith("token after") and not any("token after" in got[100 + i] for i in range(1, ld.LEAST_DOCS))


def test_no_python_in_the_plan(spark, folder):
    plan = ld.op7_line_dedup(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
