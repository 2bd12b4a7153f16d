from oracle import same
from quernel.llm import quality_rules as q

SCHEMA = "doc_id long, text string, w string, kept boolean"
CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def test_same_as_sql(spark, folder):
    same(q.op3_quality_rules(spark, folder), q.SQL, folder)


def test_edges(spark):
    once = " ".join(chr(97 + i) * 3 for i in range(12))
    texts = [None, "", " \n\t ", CLEAN, CLEAN, once + "\n" + once, "x " * 20_000, "#$% " * 30, CLEAN.upper(), "1234 5678 " * 2 + CLEAN]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in q.features(docs, q.Cascade()).collect()}
    assert len(got) == len(texts)
    assert [got[i]["n_words"] for i in range(3)] == [0, 0, 0] and got[0]["base_failed"]
    assert got[3]["kept"] and got[4]["kept"] and got[9]["kept"]
    assert (got[5]["n_repeat_words"], got[5]["n_dup_lines"]) == (24, 1)
    assert got[6]["n_repeat_words"] == 20_000 and not got[6]["kept"]
    assert not got[7]["kept"] and not got[8]["kept"]
    kept = q.Cascade().fit(docs).keep(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert q.features(docs, q.Cascade().fit(docs)).count() == 0 and q.Cascade().fit(docs).keep(docs).count() == 0


def test_order_is_by_rejections_per_second(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fitted = q.Cascade().fit(docs)
    assert sorted(r.name for r in fitted.rules) == sorted(r.name for r in q.BASE + q.FURTHER)
    assert [r.worth for r in fitted.rules] == sorted((r.worth for r in fitted.rules), reverse=True)
    # A rule that looks at every window of words costs more a row than one that counts words.
    cost = {r.name: r.seconds for r in fitted.rules}
    assert cost["repetition"] > 3 * cost["few_words"]
    reason = docs.select(fitted.reason(docs["text"], q.words(docs["text"])).alias("r"), fitted.verdict(docs["text"], q.words(docs["text"])).alias("v")).collect()
    assert all((r["r"] is None) == r["v"] for r in reason) and any(r["r"] for r in reason)


def test_rules_are_picked_by_what_is_left():
    rules = [q.Rule("a", None, 1.0), q.Rule("b", None, 1.0), q.Rule("c", None, 2.0), q.Rule("d", None, 1.5)]
    # b rejects what a does and less; c rejects one more; d nothing
    rejects = [[True, True, False, False], [True, True, False, False], [True, False, False, False], [False, False, True, False], [False] * 4]
    got = q.ordered(rules, rejects)
    assert [r.name for r in got] == ["a", "c", "b", "d"] and [r.rejected for r in got] == [0.6, 0.2, 0.0, 0.0]


def test_fit_on_nulls_only(spark):
    docs = spark.createDataFrame([(i, None, "x", None) for i in range(5)], SCHEMA)
    fitted = q.Cascade().fit(docs)
    assert fitted.rules[0].name == "few_words" and fitted.keep(docs).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = q.op3_quality_rules(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
