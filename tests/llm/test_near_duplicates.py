import random

import numpy as np
import pytest

import plain
from quernel.llm import near_duplicates as nd


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_on_documents(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert found(nd.op9_near_duplicates(spark, folder)) == plain.components(docs, 3, 85)


@pytest.mark.parametrize("block", [nd.BLOCK, 4])
def test_a_family_of_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = {}
    for i in range(60):
        words = list(base) if i % 3 else list(docs[rng.choice(list(docs))].split() if docs else base)
        for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(300)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = plain.components(docs, 5, 80)
    assert len({c for _, c in want.values()}) > 1
    assert found(nd.components(df)) == want


def test_edges(spark):
    ten, other = "a b c d e f g h i j", "q w e r t y u i o p"
    rows = [(5, ten), (2, ten), (2, other), (9, other), (None, ten), (7, None), (8, " "), (11, "x y"), (12, "X  y"), (13, "z"), (13, "z")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, g string, n_shingles int")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.components(df).collect()}
    assert got == {(5, 6, 2, False), (2, 6, 2, True), (9, 6, 2, False), (None, 6, None, True), (7, 0, 7, True), (8, 0, 8, True), (11, 1, 11, True), (12, 1, 11, False), (13, 1, 13, True)}
    kept = nd.keep(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 2, 7, 8, 11, 13, 13]
    assert nd.components(df.limit(0)).count() == 0


def test_a_family_of_unlinked_classes_needs_no_blocks(spark, monkeypatch):
    """Classes that share half of their shingles with a hub, and little else with each other."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    docs = {i: " ".join(common + [f"o{rng.randrange(10**6)}" for _ in range(50)]) for i in range(300)}
    docs |= {1000 + i: docs[i] + f" end{i}" for i in range(0, 300, 3)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    sent = []
    blocks = nd._in_blocks
    monkeypatch.setattr(nd, "_in_blocks", lambda around, *more: sent.append((around.count(), around.select("b").distinct().count())) or blocks(around, *more))
    assert found(nd.components(df)) == plain.components(docs, 5, 80)
    assert sent[0][1] <= 200  # of 400 classes, those that have a copy


def test_same_as_brute_force_on_a_thousand_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert found(nd.op9_near_duplicates(spark, "/root/testdata/sf0.01")) == plain.components(docs, 3, 85)


def test_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in nd.connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_overlap_bounds_hold_for_random_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 20, 40, 47, 48, 60, 100, 400):
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n, np.uint64)
            swap = rng.integers(0, max(1, int(n * 0.1)) + 1)
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 63, rng.integers(0, swap + 1), np.uint64)]))
            a = np.unique(a)
            same = len(np.intersect1d(a, b))
            if same * 100 < 80 * (len(a) + len(b) - same):
                continue
            x, y = a[: nd.SKETCH], b[: nd.SKETCH]
            assert len(np.intersect1d(x, y)) >= max(nd.overlap(len(x)), nd.overlap(len(y)))


def test_block_links_join_components_only():
    sets = [(bytes([i]), i // 2, np.arange(i, i + 100, dtype=np.uint64)) for i in range(6)]
    pairs = nd.block_links(sets[:3], sets, 90)
    assert pairs and all(a[0] // 2 != b[0] // 2 for a, b in pairs)
