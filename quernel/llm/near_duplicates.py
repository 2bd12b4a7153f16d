"""Near-duplicate documents by bottom-k sketches.

A document's set holds its distinct word shingles, as 64-bit hashes of one hash function; its
sketch is the k smallest. Documents of equal sets form a class, and only classes are compared.

* Inverted lists of retained values: two sets of Jaccard similarity t or more share at least
  ``overlap(k)`` sketch values (but for a chance below ``MISS``; small sets, retained whole, share
  them for certain). With values ordered by how many classes retain them, rarest first, two such
  classes therefore meet in the list of one of their first k - overlap + 1 values; only these are
  filed.
* In a list, every class is compared with one *hub*, the class whose values are retained most
  often. Where the classes around a hub then are in one component, nothing is left to do; pairs
  within a component change nothing and are not looked for. The classes around the other hubs are
  filed again under their full sets, rarest values first: sets of similarity t have one of their
  first n - tn + 1 values in common, so that classes none of whose first values another class
  has are done. What is left around a hub outside
  its largest component is held against all the others in blocks of ``BLOCK`` sets: a task gets
  two blocks and finds all their intersections at once by a product of incidence matrices, and
  gives links between components only. So no link between components is lost.
* Estimation on the union's sketch drops pairs that cannot reach t; exact Jaccard on the full
  sets, made from the whole texts again, confirms the rest.

Links make components by alternating large-star and small-star steps on tables; nothing of the
documents or links reaches the driver.

Defined results: null or blank texts have empty sets, are linked with nothing and kept; a text of
fewer words than a shingle has its whole sequence as one shingle; rows that share an id are one
document, and are linked as any of them is; a row whose id is null is linked with nothing, its
component is null and it is kept; texts of any length are read whole, and memory is that of the longest;
of ties the smallest id or hash decides; an empty table gives an empty table; columns other than id and
text are not read by ``components`` and pass unchanged through ``keep``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, pieces, raw, shingle_hashes, table, word_hashes, written

SHINGLE = 5
#: Least similarity, in hundredths.
SIMILARITY = 80
SKETCH = 48
#: Chance of a link that no list shows.
MISS = 1e-7
#: Classes that one task compares with the first class of a list.
PER_TASK = 400
#: Sets in a block, and values that are multiplied at once.
BLOCK = 512
COLUMNS = 1 << 14
#: Counters of values, of which the least frequent come first when classes are filed again.
CELLS = 1 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    return np.unique(shingle_hashes(word_hashes(words), size))


def overlap(size: int, similarity: int = SIMILARITY, sketch: int = SKETCH) -> int:
    """Sketch values that a set of ``size`` shares with any set it is to be linked with."""
    if size < sketch:
        sure = -(-size * similarity // 100)
        return max(1, sure - max(0, size * 100 // similarity - sketch))
    t, total, least = similarity / 100, 0.0, 0
    for i in range(sketch):
        total += math.comb(sketch, i) * t**i * (1 - t) ** (sketch - i)
        if total > MISS:
            break
        least = i
    return max(1, least)


def _longs(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles, the set's digest and its sketch."""

    def run(batches):
        for b in pieces(batches, "t"):
            sets = [shingle_set(t, shingle) for t in raw(b.column("t"))]
            yield {"doc_id": b.column("k"), "n_shingles": [len(s) for s in sets], "g": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sketch": pa.array([_longs(s[:SKETCH]) for s in sets], pa.list_(pa.int64()))}

    return mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_shingles long, g binary, sketch array<long>")


def _lists(classes: DataFrame, similarity: int) -> DataFrame:
    """Postings (v, g, w): the values under which each class is filed and that another class
    retains; w adds up how many classes retain each of its values."""
    retained = classes.select("g", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    # Counts are tables of their own before they are joined, so that Spark can split the joins' hot keys.
    shared = written(retained.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    mine = retained.join(shared, "v").groupBy("g", "size").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("w"))  # at most SKETCH each
    length = "CASE size " + " ".join(f"WHEN {k} THEN {k - overlap(k, similarity) + 1}" for k in range(1, SKETCH + 1)) + " END"
    # Values that no other class retains come first in the order and only take up places of the prefix.
    return mine.select("g", "w", F.explode(F.expr(f"slice(vs.v, 1, greatest(0, {length} - size + size(vs)))")).alias("v"))


def _estimated(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose lengths and union's sketch allow a link."""
    own = classes.select("g", F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    both = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
    both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity)
    least = overlap(SKETCH, similarity)

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                # The hashes' unsigned order, in which sketches are sorted
                a, b = (np.array(x, np.int64).view(np.uint64) for x in (a, b))
                union = np.union1d(a, b)[:SKETCH]
                x = np.intersect1d(a, b, assume_unique=True)
                x = int(np.searchsorted(x, union[-1], "right"))
                keep.append(x >= least if len(union) == SKETCH else x * 100 >= similarity * len(union))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    return mapped(both.select("a", "b", "sa", "sb"), run, "a binary, b binary")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """The full sets of the classes ``wanted``, from the text of each one's first document."""
    first = classes.join(wanted.select("g").distinct(), "g").select("g", "c")

    def run(batches):
        for b in pieces(batches, "t"):
            made = [(g, shingle_set(t, shingle)) for g, t in zip(b.column("g").to_pylist(), raw(b.column("t")))]
            made = [(g, x) for g, s in made if xxhash.xxh3_128_digest(x := s.tobytes()) == g]
            yield {"g": [g for g, _ in made], "x": [x for _, x in made]}

    rows = docs.select(F.col(key).alias("c"), F.col(text).alias("t")).join(first, "c")
    return mapped(rows.select("g", "t"), run, "g binary, x binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of similar sets. The partners of one class are dealt into groups of about PER_TASK."""
    many = written(pairs.groupBy("a").agg(F.count("*").alias("n")), "many")
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PER_TASK)).alias("part"))
    partners = dealt.join(sets.withColumnRenamed("g", "b"), "b").select("a", "part", "b", "x")
    firsts = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("g", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "x")

    def run(batches):
        at, mine = None, None
        for batch in batches:
            found = []
            for a, part, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "x"))):
                own = np.frombuffer(x, np.uint64)
                if b is None:
                    at, mine = (a, part), own
                elif at == (a, part):
                    same = len(np.intersect1d(mine, own, assume_unique=True))
                    if same * 100 >= similarity * (len(mine) + len(own) - same):
                        found.append((a, b))
            yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    together = partners.union(firsts).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return mapped(together, run, "a binary, b binary")


def _mixed(named: DataFrame) -> DataFrame:
    """(a, b, o, asks, n, askers) from the classes b, of component o, around hubs a, for the hubs with
    different components; asks: outside the largest one."""
    sizes = named.groupBy("a", "o").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("a").agg(F.count("*").alias("parts"), F.sum("m").alias("n"), F.max(F.struct("m", "o")).alias("top")).filter("parts > 1")
    mixed = written(mixed.select("a", "n", F.col("top.o").alias("largest"), (F.col("n") - F.col("top.m")).alias("askers")), "mixed")
    return named.join(mixed, "a").select("a", "b", "o", (F.col("o") != F.col("largest")).alias("asks"), "n", "askers")


def _around(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes around hubs with different components, as ``_mixed`` has them."""
    own = classes.select(F.col("g").alias("b"), "c").join(found.withColumnRenamed("node", "c"), "c", "left").select("b", F.coalesce("component", "c").alias("o"))
    return _mixed(members.select("a", "b").join(own, "b"))


def _prefixes(sets: DataFrame, similarity: int) -> DataFrame:
    """(v, g): the values among which each set must have one in common with any set it is to be linked
    with, in the order of their frequency in these sets. Frequencies are counted in ``CELLS``
    counters, which only decides the order; values that no other set can have are left out."""

    def count(batches):
        for b in batches:
            values = [np.frombuffer(x, np.uint64) for x in b.column("x").to_pylist()]
            cells, n = np.unique(np.concatenate([*values, np.zeros(0, np.uint64)]) % np.uint64(CELLS), return_counts=True)
            yield {"cell": pa.array(cells.astype(np.int64)), "n": pa.array(n, pa.int64())}

    got = mapped(sets.select("x"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def file(batches):
        for b in batches:
            out: list[list] = [[], []]
            for g, x in zip(b.column("g").to_pylist(), b.column("x").to_pylist()):
                own = np.frombuffer(x, np.uint64)
                often = shared.value[(own % np.uint64(CELLS)).astype(np.int64)]
                first = np.lexsort((own, often))[: len(own) - -(-len(own) * similarity // 100) + 1]
                first = own[first[often[first] > 1]].view(np.int64).tolist()
                out[0] += first
                out[1] += [g] * len(first)
            yield {"v": out[0], "g": out[1]}

    return mapped(sets.select("g", "x"), file, "v long, g binary")


def _meeting(around: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``around`` without the classes that no other class there can be linked with."""
    there = around.select(F.col("b").alias("g")).distinct()
    filed = written(_prefixes(sets.join(there, "g"), similarity), "filed")
    twice = written(filed.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v"), "twice")
    left = written(filed.join(twice, "v").select(F.col("g").alias("b")).distinct(), "left")
    return _mixed(around.join(left, "b").select("a", "b", "o"))


def block_links(left: list[tuple], right: list[tuple], similarity: int) -> list[tuple]:
    """Pairs of ids of similar sets, one of ``left`` and one of ``right``, that join different
    components; both are lists of (id, component, sorted distinct hashes)."""
    both = [*left, *right]
    size = np.array([len(x) for _, _, x in both])
    owner = np.repeat(np.arange(len(both)), size)
    _, place, times = np.unique(np.concatenate([x for _, _, x in both]), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    used = often[place]
    owner, place = owner[used], column[place[used]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    same = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, (start, start + COLUMNS))
        part = np.zeros((len(both), COLUMNS), np.float32)
        part[owner[lo:hi], place[lo:hi] - start] = 1
        same += part[: len(left)] @ part[len(left) :].T
    union = size[: len(left), None] + size[None, len(left) :] - same
    above: dict = {}

    def root(o):
        while above.setdefault(o, o) != o:
            above[o] = o = above[above[o]]
        return o

    out = []
    for i, j in zip(*np.nonzero(same * 100 >= similarity * union)):
        o, p = root(left[i][1]), root(right[j][1])
        if o != p:
            above[o] = p
            out.append((left[i][0], right[j][0]))
    return out


def _in_blocks(around: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between components around each hub."""
    rows = around.join(sets.withColumnRenamed("g", "b"), "b")
    wide, high = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("askers") / BLOCK)
    h = F.xxhash64("b")
    askers = rows.filter("asks").select("a", "b", "o", "x", F.pmod(h, high).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), wide - 1)).alias("j"), F.lit(0).alias("side"))
    others = rows.select("a", "b", "o", "x", F.explode(F.sequence(F.lit(0).cast("long"), high - 1)).alias("i"), F.pmod(h, wide).alias("j"), F.lit(1).alias("side"))

    def run(batches):
        at, sides = None, ([], [])
        for batch in batches:
            out = []
            for a, i, j, side, b, o, x in zip(*(batch.column(c).to_pylist() for c in ("a", "i", "j", "side", "b", "o", "x"))):
                if (a, i, j) != at:
                    out += block_links(*sides, similarity) if all(sides) else []
                    at, sides = (a, i, j), ([], [])
                sides[side].append((b, o, np.frombuffer(x, np.uint64)))
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}
        out = block_links(*sides, similarity) if all(sides) else []
        yield {"a": [a for a, _ in out], "b": [b for _, b in out]}

    together = askers.unionByName(others).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    return mapped(together, run, "a binary, b binary")


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (u, v): the component is its smallest node.

    Alternating large-star and small-star steps until nothing changes; every round is a table in
    the shared folder.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.toDF("node", "component").union(roots)


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable) and kept (doc_id = component_id)."""
    rows = written(sketches(docs, shingle, key, text), "sketches")
    classes = written(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("g").agg(F.min("doc_id").alias("c"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    lists = written(_lists(classes, similarity), "lists")
    hubs = written(lists.groupBy("v").agg(F.max(F.struct("w", "g")).alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    members = lists.join(hubs, "v").select(F.col("hub.g").alias("a"), F.col("g").alias("b"), "n").filter("a != b")
    members = written(members.groupBy("a", "b").agg(F.max(F.col("n") > 2).alias("wide")), "members")
    pairs = written(_estimated(members.select("a", "b"), classes, similarity), "pairs")
    wanted = pairs.union(members.filter("wide").select("a", "b")).select(F.explode(F.array("a", "b")).alias("g"))
    sets = written(_sets(docs, classes, wanted, shingle, key, text), "sets")

    links = _named(_confirmed(pairs, sets, similarity), classes).union(_shared_ids(rows, classes))
    found = written(connected(links), "components")
    around = written(_around(members.filter("wide"), classes, found), "around")
    around = written(_meeting(around, sets, similarity), "around")
    more = written(_named(_in_blocks(around, sets, similarity), classes), "links")
    if not more.isEmpty():
        found = written(connected(found.toDF("u", "v").union(more)), "components")

    named = classes.select("g", "c").join(found.withColumnRenamed("node", "c"), "c", "left").select("g", F.coalesce("component", "c").alias("component"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("g")).alias("g")).join(named, "g", "left")
    # Rows that share an id are one document: the id's own component wins over its class's.
    out = out.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left")
    out = out.withColumn("component_id", F.least("own", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) of an id with the first documents of its classes, for ids of rows with different sets."""
    several = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low != high").select("doc_id")
    return rows.join(several, "doc_id").join(classes.select("g", "c"), "g").select(F.col("doc_id").alias("u"), F.col("c").alias("v"))


def _named(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of classes as links of their first documents."""
    own = classes.select("g", "c")
    return links.join(own.toDF("a", "u"), "a").join(own.toDF("b", "v"), "b").select("u", "v")


def keep(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: of each component, those of its smallest id."""
    gone = components(docs, shingle, similarity, key, text).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), shingle=3, similarity=85)
