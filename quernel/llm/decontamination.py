"""Benchmark decontamination: which words of a document lie inside a benchmark passage.

A prefix-filtered set join over item-sized windows. A window is the set of its word shingles
with their places. Exact containment of a window of n shingles needs all of them, so that a prefix of
n - n + 1 = 1 shingle, the rarest, is the necessary one; rarity is counted over all documents.

1. Windows of the items, and the shingles (``GRAM`` words, fewer in shorter windows) of each.
2. Rarity: every document counts its shingles that may be among the windows'.
3. Each window is filed under its rarest shingle.
4. Join: a document sends its shingles that may head a window, each with the words around it,
   and these meet the windows of the same shingle. The shingle's place fixes where the window would
   start (the positional bound), start and length must fit the document (the length bound), and
   the window's words are then compared as they are.

Windows, counts, prefixes and hits are tables; only the ``Sieve`` of the shingles, of fixed size,
reaches the driver and is broadcast. It spares documents from sending what can't match; however
many windows there are, the join decides.

Defined results: a null or empty text has no words; an item without words has no windows; an
item whose id is null contaminates but is not listed; repeated item ids count once; repeated
documents are judged one by one (equal texts are sent once); an empty table of items leaves every
document clean, one of documents gives an empty table; equally rare shingles are tried in the order of
their hashes; a text is read whole, whatever its length; columns other than id and text are not
read, and pass unchanged through ``keep_clean`` whatever their names are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, mapped, pieces, raw, shingle_hashes, table, word_hashes, written

WINDOW = 10
#: Words in a shingle.
GRAM = 3

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and anything beyond ASCII."""
    return text.translate(_TO).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Distinct (window, item) pairs; a window is its words joined by spaces."""

    def run(batches):
        for b in pieces(batches, "t"):
            out = [(b" ".join(w).decode(), k) for k, t in zip(b.column("k").to_pylist(), raw(b.column("t"))) for w in dict.fromkeys(windows_of(split_words(t), size))]
            yield {"window": [w for w, _ in out], "item": [k for _, k in out]}

    return mapped(items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")), run, "window string, item string").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, n, size, at, h): a window's words n, and its shingles of ``size`` words at their places."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("window", "n", "size", "at", "h")}
            for window in b.column("window").to_pylist():
                words = window.encode().split()
                size = min(GRAM, len(words))
                for at, h in enumerate(shingle_hashes(word_hashes(words), size).view("int64").tolist()):
                    for c, v in (("window", window), ("n", len(words)), ("size", size), ("at", at), ("h", h)):
                        out[c].append(v)
            yield out

    return mapped(windows, run, "window string, n int, size int, at int, h long")


def shingle_counts(docs: DataFrame, text: str, sieve, sizes: list[int]) -> DataFrame:
    """(h, docs): how often the shingles in the sieve occur in all documents."""

    def run(batches):
        import numpy as np

        for b in pieces(batches, "t"):
            found = [h[sieve.value.holds(h)] for t in raw(b.column("t")) for w in [word_hashes(split_words(t))] for h in (shingle_hashes(w, s) for s in sizes)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield {"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())}

    return mapped(docs.select(F.col(text).alias("t")), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, offset, n, window): each window under its rarest shingle."""
    rarest = windows.join(counts.withColumnRenamed("n", "docs"), "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "h", F.col("at").alias("offset"), "n")).alias("x"))
    return rarest.select("x.h", "x.offset", "x.n", "window")


def _identity(text) -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit(WINDOW), text)


def _probed(docs: DataFrame, key: str, text: str, sieve, sizes: list[int], window: int) -> DataFrame:
    """Per row: doc_id, two hashes of the text, n_words, and the shingles that may head a window,
    each with the words around it that a window could hold."""
    k1, k2 = _identity(F.col(text))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), k1.alias("k1"), k2.alias("k2"))
    found = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("near", pa.string())]))

    def probe(words: list[bytes]) -> list[dict]:
        hashes, out = word_hashes(words), []
        for size in sizes:
            h = shingle_hashes(hashes, size)
            for at in sieve.value.holds(h).nonzero()[0].tolist():
                lo = max(0, at + size - window)
                out.append({"h": int(h[at].view("int64")), "at": at, "lo": lo, "near": b" ".join(words[lo : at + window]).decode()})
        return out

    def run(batches):
        for b in pieces(batches, "t"):
            words = [split_words(t) for t in raw(b.column("t"))]
            yield {"doc_id": b.column("k"), "k1": b.column("k1"), "k2": b.column("k2"), "n_words": list(map(len, words)), "found": pa.array(list(map(probe, words)), found)}

    return mapped(rows, run, f"doc_id {docs.schema[key].dataType.simpleString()}, k1 long, k2 long, n_words long, found array<struct<h: long, at: int, lo: int, near: string>>")


def matches(docs: DataFrame, pairs: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, k1, k2, n_words), and where windows occur in their texts (k1, k2, start, end, window)."""
    context = docs.sparkSession.sparkContext
    windows = written(window_shingles(pairs.select("window").distinct()), "window-shingles")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most GRAM
    counts = written(shingle_counts(docs, text, context.broadcast(Sieve.of(windows, "h")), sizes), "rarity")
    filed = written(prefixes(windows, counts), "prefixes")
    probed = written(_probed(docs, key, text, context.broadcast(Sieve.of(filed, "h")), sizes, window), "probed")
    sent = probed.select("k1", "k2", F.explode("found").alias("e")).select("k1", "k2", "e.*").distinct()
    start = F.col("at") - F.col("offset")
    words = F.slice(F.split("near", " "), start - F.col("lo") + 1, F.col("n"))
    both = sent.join(filed, "h").filter((start >= F.col("lo")) & (start + F.col("n") <= F.col("lo") + F.size(F.split("near", " "))))
    hits = both.filter(F.array_join(words, " ") == F.col("window")).select("k1", "k2", start.alias("start"), (start + F.col("n")).alias("end"), "window")
    return probed.drop("found"), written(hits.distinct(), "hits")


def _covered(places):
    """Size of the union of the sorted (start, end) ranges."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("until"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(p["start"], a["until"]))).cast("long").alias("n"), F.greatest(a["until"], p["end"]).alias("until"))
    return F.aggregate(places, first, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit (words inside a window's occurrence), n_items, items_sha256, contaminated."""
    pairs = written(item_windows(items, item_key, item_text, window), "windows")
    rows, hits = matches(docs, pairs, key, text, window)
    hit = hits.select("k1", "k2", "start", "end").distinct().groupBy("k1", "k2").agg(_covered(F.sort_array(F.collect_list(F.struct("start", "end")))).alias("n_hit"))  # at most the places of one text
    named = hits.select("k1", "k2", "window").distinct().join(pairs.filter("item IS NOT NULL"), "window").select("k1", "k2", "item").distinct()
    listed = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("items"))  # the items that one text holds
    marks = written(hit.join(listed, ["k1", "k2"], "left").select("k1", "k2", "n_hit", F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256")), "marks")
    none = F.lit(0).cast("long")
    out = rows.join(marks, ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns as they are. Texts are known by two hashes,
    so that rows do not leave the JVM to be filtered."""
    pairs = written(item_windows(items, item_key, item_text, window), "windows")
    _, hits = matches(docs, pairs, key, text, window)
    dirty = written(hits.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "dirty")
    k1, k2 = _identity(docs[text])
    return docs.join(dirty, (k1 == dirty["__k1"]) & (k2 == dirty["__k2"]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, n, array_to_string(w[s:s+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
