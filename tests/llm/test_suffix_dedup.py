import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from quernel.llm import suffix_dedup as sd


def query(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in sd.spans(df, **options).collect()}


def test_query_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in docs]
    want = {(r["doc_id"], *x, y[1]) for r, x, y in zip(docs, plain.repeats(texts, 400), plain.repeats(texts, sd.PASSAGE))}
    assert {tuple(r) for r in sd.op8_suffix_dedup(spark, folder).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=30), st.sampled_from([0, 8, 64]))
def test_deep_shallow_sorts(strings, shallow):
    assert [strings[i] for i in sd.deep_shallow(strings, 0, shallow)] == sorted(strings)


@pytest.mark.parametrize("group", [sd.GROUP, 1, 4])
def test_short_lengths_and_parted_groups(spark, group):
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefg ") for _ in range(n)) for n in (49, 50, 51, 60, 100, 200)]
    docs = []
    for i in range(60):
        parts = ["".join(rng.choice("hijklmno ") for _ in range(rng.randrange(0, 80))) for _ in range(3)]
        passage = rng.choice(passages)
        cut = rng.choice((0, 0, rng.randrange(len(passage))))  # some hold a part of it
        parts.insert(rng.randrange(3), passage[cut:] if i % 2 else passage[: len(passage) - cut])
        docs.append((i, "".join(parts)))
    docs += [(100, docs[0][1]), (101, "xy" * 300), (102, None), (103, ""), (104, "zz"), (105, "é" * 100)]
    texts = [t for _, t in docs]
    want = {(i, n, s, digest, p[1]) for (i, _), (n, _, s, digest), p in zip(docs, plain.repeats(texts, 70), plain.repeats(texts, 50))}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sd.spans(df, length=70, passage=50, window=16, group=group).collect()
    assert {(r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest(), sum(e - s for s, e in r["passages"])) for r in got} == want


@pytest.mark.parametrize("group", [sd.GROUP, 2])
def test_planted_passages_of_just_under_at_and_over_the_length(spark, group):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    docs = []
    for k, n in enumerate((sd.PASSAGE - 1, sd.PASSAGE, 399, 400, 401, 1500)):
        passage = text(n)
        docs += [(100 * k + i, f"{text(rng.randrange(900))}{i}{passage}{i}{text(rng.randrange(900))}") for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (sum(e - s for s, e in r["spans"]), sum(e - s for s, e in r["passages"])) for r in sd.spans(df, passage=sd.PASSAGE, group=group).collect()}
    texts = [t for _, t in docs]
    assert got == {i: (x[1], y[1]) for (i, _), x, y in zip(docs, plain.repeats(texts, 400), plain.repeats(texts, sd.PASSAGE))}
    assert all((got[i][0] > 0) == (i >= 300) and (got[i][1] > 0) == (i >= 100) for i in got)


def test_anchors_do_not_depend_on_segments():
    rng = random.Random(1)
    for n in (0, 40, 222, 223, 224, 5000):
        text = bytes(rng.randrange(97, 101) for _ in range(n))
        want = sd.anchors(text)
        assert all(sd.anchors(text, segment=k) == want for k in (1000, 4096)) and (len(want) > 0) == (n >= sd.WINDOW + sd.GRAM - 1)


def test_long_texts_and_extra_columns(spark):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    tail = body[700_000:700_450]
    docs = [(1, body, "x"), (2, "other " + tail, "y"), (3, "line\n" * 20_000, "z")]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in sd.spans(spark.createDataFrame(docs, "doc_id long, text string, k1 string")).collect()}
    assert got == {1: [(700_000, 700_450)], 2: [(6, 456)], 3: [(0, 100_000)]}


def test_edges(spark):
    long = "abcdefghij" * 50
    docs = [(1, None), (2, ""), (3, "x" * 399), (4, "x" * 399), (5, "unique " + "".join(map(chr, range(300, 900)))), (None, long[:450]), (None, long[:450])]
    got = query(spark, docs)
    assert (1, 0, 0, b"") in got and (3, 399, 0, b"x" * 399) in got and (None, 450, 1, b"") in got
    assert next(x for x in got if x[0] == 5)[2] == 0
    assert sd.spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_merge_where_they_touch():
    assert sd.merged([(5, 9), (0, 5), (12, 14), (13, 20)]) == [(0, 9), (12, 20)]
