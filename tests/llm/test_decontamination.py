import hashlib
import random

import pytest

import plain
from oracle import same
from quernel.llm import common
from quernel.llm import decontamination as d

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def check(spark, docs, items, **options):
    got = d.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), **options).collect()
    want = plain.decontaminated(docs, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == {
        k: (n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for k, (n, h, i) in want.items()
    }


def test_same_as_sql(spark, folder):
    same(d.op2_decontamination(spark, folder), d.SQL, folder)


def test_edges(spark):
    docs = {1: None, 2: "", 3: "x " + ITEM.upper().replace(" ", ",\n") + " y", 4: ITEM, 5: "one two", 6: "a b c one two", 7: "é ß 漢字 " * 30, 8: "tail " * 5000 + ITEM[:60] + " ten", 9: ITEM}
    items = {1: ITEM, 2: "One, two!", 3: None, 4: "...", 10: "x " + ITEM, 11: "é ß 漢字"}
    check(spark, docs, items)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, ITEM), (1, ITEM), (1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM)], "item_id long, text string")
    got = d.decontaminate(docs, items).collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(12, 0, True)] * 3
    assert {r["contaminated"] for r in d.decontaminate(docs, items.limit(0)).collect()} == {False}
    assert d.decontaminate(docs.limit(0), items).count() == 0


def test_keep_clean_leaves_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "fine", "b")], "doc_id long, text string, k1 string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = d.keep_clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "fine", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("a b c d".split()) for _ in range(rng.randrange(n)))
    check(spark, {i: text(60) for i in range(80)}, {i: text(16) for i in range(25)})


def test_a_full_sieve_lets_everything_through_and_changes_nothing(spark, monkeypatch):
    """A benchmark far too large for the sieve only costs more rows."""
    monkeypatch.setattr(common.Sieve, "BITS", 64)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = {i: text(80) for i in range(40)}
    items = {i: " ".join(docs[i].split()[k : k + 14]) for i, k in zip(range(0, 40, 2), range(0, 60, 3))} | {99: text(40), 100: "w1 w2", 101: "w7"}
    check(spark, docs, items)


def test_very_long_text_and_many_copies(spark):
    docs = {1: "filler words " * 200_000 + ITEM} | {i: ITEM + " same" for i in range(2, 60)}
    check(spark, docs, {7: ITEM, 8: "filler words filler"})
