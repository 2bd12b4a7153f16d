import hashlib
import re

import plain
from quernel.llm import bpe

import corpus_pipeline


def reference(docs, items):
    """The stages after the native ones, plainly: id -> text of what is left."""
    groups = plain.components(docs, 5, 80)
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    hits = plain.decontaminated(docs, items)
    return {i: t for i, t in docs.items() if not hits[i][1]}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:2]):
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, folder), f"stage{k}")
        assert docs.columns == columns and docs.count() <= before.count()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(len(re.findall(r"\S+", t)) > 0 for t in left.values())
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = reference(left, items)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want)
    coder = bpe.coder(bpe.default_path())
    for i, t in want.items():
        assert got[i]["n_tokens"] == len(coder.encode(t)) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_edges_of_the_stages(spark, folder, tmp_path):
    """Nulls, empty and repeated rows, copies, a benchmark passage, extra columns of clashing names, and no rows."""
    words = [f"{a}{b}rd" for a in "bcdfghjklm" for b in ("a", "e", "i", "o", "u", "ay", "oo")]
    text = lambda k: " ".join(words[(i * k + k) % 67] + words[(i + k) % 61] for i in range(60))
    item = " ".join(f"passage{i}x" for i in "abcdefghijkl")
    rows = [(1, None), (2, ""), (3, " \n "), (4, text(3)), (4, text(3)), (5, text(3) + " end"), (None, text(5)), (6, text(7) + " " + item), (7, text(11)), (8, (text(13) + "\n") + "long " * 3 + " ".join("w" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(50_000)))]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k1 string, n_words int")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        empty = corpus_pipeline.written(stage(spark, empty, str(tmp_path)), name)
        assert empty.count() == 0
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "k1", "n_words"]
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 4, 4, 7, 8]


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert {"op2_decontamination", "op3_quality_rules", "op7_line_dedup"} <= set(__spark_entry__.oracle_sql())
