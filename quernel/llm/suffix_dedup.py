"""Exact removal of repeated byte strings with sorted suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in any
document, is removed. Suffixes are taken at anchors only: of every ``WINDOW`` successive
``GRAM``-byte grams the one of the smallest hash, the first of equal ones. The choice depends on
the window's own bytes, so two equal strings hold an anchor at the same place,
and the part right of it that any such string must have, its core, is the same too.

1. Anchors whose core occurs nowhere else are dropped (counts by core, pre-aggregated).
2. An anchor's context is all that strings of ``LENGTH`` bytes around it can reach. Anchors whose
   whole context occurs twice are settled at once: all of it is repeated.
3. The other anchors of a core, with one representative of each settled context, are ordered by
   their suffixes with deep-shallow sorting: multikey quicksort to a shallow depth, then blind
   tries for the groups that still agree. Every interval of suffixes that agree for r bytes is
   then ordered by what lies left of the anchors; neighbours that agree for l bytes there, with
   l + r at least ``LENGTH``, are repeats of l + r bytes.
4. A core of more contexts than one task should sort (``GROUP``) is parted first by longer common
   strings: strings of which the anchor is the o-th byte are looked for in parts of the range
   of o, from a to b; contexts that can share one agree in a bytes to the left and ``LENGTH`` - b to
   the right, so these name the part's groups. Contexts that agree in all that the part can reach
   are settled and one of them goes on, with the b - a bytes on either side that the part can reach
   beyond what its group has in common. Parts of what is still too large are parted again; a
   range of one o leaves nothing to sort.

With ``passage`` the same sorted suffixes also show repeats of that many bytes, fewer than
``LENGTH``; they are reported and not removed.

Texts are known by a 128-bit hash; equal texts of ``LENGTH`` bytes or more are repeats as a whole.
Contexts that are equal as a whole are known by 128-bit hashes too.

Defined results: a null or empty text has 0 bytes and nothing removed; texts shorter than
``LENGTH`` are never touched; repeated rows are repeats of each other; which of equal strings comes first
makes no difference, as all of them go; an empty table gives an empty table; a text is read whole,
in overlapping segments of ``SEGMENT`` bytes, whatever its length; columns other than id and text are not
read, whatever their names are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, erase, mapped, pieces, raw, scope, table, written

LENGTH = 400
#: Bytes of the shorter repeats that the query reports beside them: about 50 words at least.
PASSAGE = 256
WINDOW = 192
GRAM = 32
#: Most contexts that are sorted together; each takes up to about 600 bytes.
GROUP = 16_384
#: Parts into which a range of places is cut when a group is larger.
PARTS = 4
#: Grams that are hashed at once.
SEGMENT = 1 << 20
#: Bytes that quicksort takes as one character, and the depth beyond the core from which blind tries sort.
CHUNK = 8
SHALLOW = 64

#: Low bits of a gram's hash that hold its place in the segment.
_PLACE = (1 << 22) - 1
_BYTES = np.random.default_rng(400).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """For each gram of a segment its hash, with its place in the low bits."""
    n = len(b)
    powers = np.full(n, _P)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * powers, out=sums[1:])
    inverse = np.full(n - gram + 1, _INVERSE)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = (sums[gram:] - sums[:-gram]) * inverse
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM, segment: int = SEGMENT) -> list[int]:
    """Places of the grams that are smallest in some window of ``window`` grams."""
    found: list[np.ndarray] = []
    whole = np.frombuffer(text, np.uint8)
    for start in range(0, len(whole) - window - gram + 2, segment):
        h = _hashes(whole[start : start + segment + window + gram - 2], gram)
        step = 1
        while step * 2 <= window:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if step < window:
            h = np.minimum(h[: len(h) - (window - step)], h[window - step :])
        changes = np.flatnonzero(np.diff(h)) + 1
        found.append((h[np.append(0, changes)] & np.uint64(_PLACE)).astype(np.int64) + start)
    return np.unique(np.concatenate(found)).tolist() if found else []


class Reach:
    """How far strings of ``length`` bytes that hold an anchor can reach; ``least`` bytes or more are looked for."""

    def __init__(self, length: int = LENGTH, passage: int | None = None, window: int = WINDOW):
        self.length, self.least, self.window = length, min(length, passage or length), window
        self.left, self.core = window - 1, self.least - window + 1
        if self.core < GRAM:
            raise ValueError(f"strings of {self.least} bytes need windows of {self.least - GRAM + 1} grams or fewer")

    def around(self, at: int, n: int) -> tuple[int, int]:
        return min(self.left, at), min(self.length, n - at)


def agreement(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """A trie that stores branching places only; a new string is compared with one other."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # leaf: [-1, members]; inner: [depth, {byte: node}, a member]

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:  # down without looking at what lies between branches
            below = node[1].get(self._byte(i, node[0]))
            if below is None:
                break
            node = below
        other = node[1][0] if node[0] < 0 else node[2]
        s, t = self.strings[i], self.strings[other]
        depth = agreement(s, t)
        if depth == len(s) == len(t) and node[0] < 0:
            node[1].append(i)
            return
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][self._byte(i, node[0])]
        if node[0] == depth:
            node[1][self._byte(i, depth)] = [-1, [i]]
            return
        new = [depth, {self._byte(other, depth): node, self._byte(i, depth): [-1, [i]]}, other]
        if above is None:
            self.root = new
        else:
            above[1][self._byte(i, above[0])] = new

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.extend(node[1])
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        return out


def deep_shallow(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The strings' numbers in order; all agree in their first ``start`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), start)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out.extend(group)
        elif depth >= start + shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            out.extend(trie.order())
        else:
            keys = [strings[i][depth : depth + CHUNK] for i in group]
            pivot = keys[len(keys) // 2]
            stack.append(([i for i, k in zip(group, keys) if k > pivot], depth))
            same = [i for i, k in zip(group, keys) if k == pivot]
            stack.append((same, depth + CHUNK if len(pivot) == CHUNK else start + shallow))
            stack.append(([i for i, k in zip(group, keys) if k < pivot], depth))
    return out


def intervals(depths: list[int], least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of every maximal run of sorted strings that agree for ``depth`` bytes,
    for depths of ``least`` or more; ``depths[i]`` is the agreement of strings i and i + 1."""
    out, stack = [], []
    for i, d in enumerate([*depths, -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if d >= least and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return out


def repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, core: int = 0) -> list[list[tuple[int, int]]]:
    """For each context the (l, r), largest only, such that its l bytes left and r bytes right of
    the anchor, ``length`` or more together, are those of another context. ``lefts`` are reversed."""
    found: list[list[tuple[int, int]]] = [[] for _ in lefts]
    same = all(r[:core] == rights[0][:core] for r in rights)
    order = deep_shallow(rights, core if same else 0)
    depths = [agreement(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    rank = {i: k for k, i in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    for r, first, last in intervals(depths, core):
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        near = [agreement(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for i, l in zip(members, map(max, [0, *near], [*near, 0])):
            if l + r >= length and not any(x >= l and y >= r for x, y in found[i]):
                found[i].append((l, r))
    return found


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), t.alias("t")).select("doc_id", "t", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(LENGTH), "t").alias("k2"))


def _anchored(named: DataFrame, reach: Reach) -> DataFrame:
    """(core, u1, u2, k1, k2, at): for each text the places of every different context of its anchors."""

    def run(batches):
        for b in pieces(batches, "t"):
            cores, u1, u2, owner, ats = [], [], [], [], []
            for row, text in enumerate(raw(b.column("t"))):
                mine: dict[tuple[int, int], list[int]] = {}
                n = len(text)
                for at in anchors(text, reach.window):
                    left, right = reach.around(at, n)
                    if right >= reach.core:
                        mine.setdefault((xxhash.xxh3_64_intdigest(text[at : at + reach.core]), xxhash.xxh3_128_intdigest(text[at - left : at + right], left)), []).append(at)
                for (core, u), at in mine.items():
                    cores.append(core)
                    u1.append(u >> 64)
                    u2.append(u & 0xFFFFFFFFFFFFFFFF)
                    owner.append(row)
                    ats.append(at)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cores, u1, u2)]
            take = pa.array(owner, pa.int64())
            yield {"core": longs[0], "u1": longs[1], "u2": longs[2], "k1": b.column("k1").take(take), "k2": b.column("k2").take(take), "at": pa.array(ats, pa.list_(pa.int32()))}

    long_enough = named.filter(F.octet_length("t") >= reach.least)
    return mapped(long_enough.select("t", "k1", "k2"), run, "core long, u1 long, u2 long, k1 long, k2 long, at array<int>")


def _twice(df: DataFrame, *keys: str, also: tuple = ()) -> DataFrame:
    """The keys, and whether they occur at two places (``twice``)."""
    place = F.xxhash64("k1", "k2", F.get("at", F.lit(0)))
    counted = df.groupBy(*keys).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max(F.size("at")).alias("most"), *also)
    return counted.withColumn("twice", F.expr("low != high OR most > 1")).drop("low", "high", "most")


def _among(named: DataFrame, wanted: DataFrame, others: bool = False) -> DataFrame:
    """The rows of ``named`` of which the text may be one of ``wanted`` (k1, k2), so that the others need
    not be shuffled, or with ``others`` the rows of which it isn't."""
    sieve = named.sparkSession.sparkContext.broadcast(Sieve.of(wanted, "k1"))

    def run(batches):
        for b in batches:
            found = sieve.value.holds(b.column("k1").to_numpy(zero_copy_only=False).view(np.uint64))
            kept = b.filter(pa.array(found != others))
            yield dict(zip(kept.schema.names, kept.columns))

    return mapped(named, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema))


def _contexts(named: DataFrame, asked: DataFrame, reach: Reach) -> DataFrame:
    """The bytes around the asked anchors (core, k1, k2, at, single)."""
    by_text = written(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "at", "single")).alias("asked")), "by-text")  # at most the anchors of one text

    def run(batches):
        seen = set()
        for b in pieces(batches, "t"):
            out: dict[str, list] = {c: [] for c in ("core", "k1", "k2", "at", "single", "l", "r")}
            for k1, k2, wanted, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("asked").to_pylist(), raw(b.column("t"))):
                if (k1, k2) in seen:  # a copy
                    continue
                seen.add((k1, k2))
                for x in wanted:
                    left, right = reach.around(x["at"], len(text))
                    for c, v in (("core", x["core"]), ("k1", k1), ("k2", k2), ("at", x["at"]), ("single", x["single"]), ("l", text[x["at"] - left : x["at"]][::-1]), ("r", text[x["at"] : x["at"] + right])):
                        out[c].append(v)
            yield out

    rows = _among(named.select("t", "k1", "k2"), by_text).join(by_text, ["k1", "k2"])
    return mapped(rows, run, "core long, k1 long, k2 long, at int, single boolean, l binary, r binary")


_RANGES = "k1 long, k2 long, start int, end int"


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Repeats (k1, k2, start, end) around single anchors, by sorting the contexts of each group: rows
    (g1, g2, shared, least, k1, k2, start, end, single, l, r). From start to end all of a group are
    equal, l and r are what lies left and right of that, r of all agrees in its first ``shared``
    bytes, and ``least`` bytes of l and r together make a repeat."""

    def solve(group: list[tuple]) -> list[tuple]:
        group = list({g[2:5]: g for g in group}.values())
        if len(group) < 2:
            return []
        shared, least = group[0][:2]
        found = repeats([g[7] for g in group], [g[8] for g in group], least, shared)
        return [(k1, k2, start - l, end + r) for (_, _, k1, k2, start, end, single, _, _), pairs in zip(group, found) if single for l, r in pairs]

    def run(batches):
        at, group = None, []
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("g1", "g2", "shared", "least", "k1", "k2", "start", "end", "single", "l", "r"))):
                if row[:2] != at:
                    out += solve(group)
                    at, group = row[:2], []
                group.append(row[2:])
            yield dict(zip(("k1", "k2", "start", "end"), zip(*out))) if out else {c: [] for c in ("k1", "k2", "start", "end")}
        out = solve(group)
        yield dict(zip(("k1", "k2", "start", "end"), zip(*out))) if out else {c: [] for c in ("k1", "k2", "start", "end")}

    return mapped(contexts.repartition("g1", "g2").sortWithinPartitions("g1", "g2"), run, _RANGES)


def _parted(contexts: DataFrame, reach: Reach, least: int, group: int) -> list[DataFrame]:
    """The same for groups that are too large: they are parted by longer common strings."""
    found, spent = [], []
    rows = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(reach.left)})
    while True:
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / PARTS).cast("int")
        rows = rows.withColumn("step", step).withColumn("a", F.explode(F.sequence("lo", "hi", "step"))).withColumn("b", F.least(F.col("a") + F.col("step") - 1, F.col("hi")))
        rows = rows.withColumn("shared", least - F.col("b")).filter("length(l) >= a AND length(r) >= shared")
        own = [F.col("a"), F.expr("substring(l, 1, a)"), F.expr("substring(r, 1, shared)")]
        all_of_it = [F.expr("substring(l, 1, b)"), F.expr(f"substring(r, 1, {least} - a)")]
        rows = rows.select(
            F.xxhash64("g1", *own).alias("g1"), F.xxhash64("g2", F.lit(1), *own).alias("g2"), "shared", F.col("a").alias("lo"), F.col("b").alias("hi"),
            F.xxhash64(*all_of_it).alias("x1"), F.xxhash64(F.lit(1), *all_of_it).alias("x2"), "k1", "k2", "at", "single",
            F.expr("at - least(b, length(l))").alias("start"), F.expr(f"at + least({least} - a, length(r))").alias("end"),
        )
        with scope() as made:
            rows = written(rows, "parts")
            alike = rows.groupBy("g1", "g2", "x1", "x2").agg(F.min(F.struct("k1", "k2", "at", "shared", "lo", "hi")).alias("first"), F.count("*").alias("n"), F.max("single").alias("single"))
            alike = written(alike.select("g1", "g2", "x1", "x2", "first", "n", (F.col("single") & (F.col("n") == 1)).alias("open")), "alike")
            settled = rows.filter("single").join(alike.filter("n > 1").select("g1", "g2", "x1", "x2"), ["g1", "g2", "x1", "x2"])
            settled = settled.filter(F.col("end") - F.col("start") >= least).select("k1", "k2", "start", "end")
            sizes = written(alike.groupBy("g1", "g2").agg(F.count("*").alias("m"), F.max("open").alias("open")).filter("m > 1 AND open").select("g1", "g2", "m"), "sizes")
            firsts = written(alike.join(sizes, ["g1", "g2"]).select("g1", "g2", "first.*", alike["open"].alias("single"), "m"), "firsts")
            rows = firsts.join(contexts.select("k1", "k2", "at", "l", "r"), ["k1", "k2", "at"])
            # All of a group agree in lo bytes to the left and ``shared`` to the right: only what a string can reach beyond is sorted.
            beyond = rows.filter(F.col("m") <= group).select(
                "g1", "g2", F.lit(0).alias("shared"), F.expr("hi - lo").alias("least"), "k1", "k2", F.expr("at - lo").alias("start"), F.expr("at + shared").alias("end"), "single",
                F.expr("substring(l, lo + 1, hi - lo)").alias("l"), F.expr("substring(r, shared + 1, hi - lo)").alias("r"),
            )
            found.append(written(settled.union(_sorted_groups(beyond)), "ranges"))
        # What goes on is made of ``firsts`` alone.
        erase(contexts.sparkSession, [*spent, *made[:3]])
        spent = made[3:4]
        if firsts.filter(F.col("m") > group).isEmpty():
            return found
        rows = rows.filter(F.col("m") > group)


def repeated(named: DataFrame, reach: Reach, group: int = GROUP) -> DataFrame:
    """(k1, k2, found): for each text the anchors whose whole context is repeated (at, -1), and
    repeated ranges (start, end)."""
    anchored = _anchored(named, reach)
    # Counts are tables of their own before they are joined, so that Spark can split the join's hot keys.
    cores = written(_twice(anchored, "core").filter("twice").select("core"), "cores")
    live = written(anchored.join(cores, "core"), "anchors")
    place = F.struct("k1", "k2", F.get("at", F.lit(0)).alias("at"))
    contexts = written(_twice(live, "core", "u1", "u2", also=(F.min(place).alias("place"),)).withColumnRenamed("twice", "settled"), "contexts")
    open_cores = written(contexts.groupBy("core").agg(F.count("*").alias("n"), F.count_if(~F.col("settled")).alias("singles")).filter("n > 1 AND singles > 0").select("core", "n"), "open-cores")
    asked = written(contexts.join(open_cores, "core").select("core", "n", "place.k1", "place.k2", "place.at", (~F.col("settled")).alias("single")), "asked")

    def bytes_of(some: DataFrame) -> DataFrame:
        return _contexts(named, some, reach).select(F.col("core").alias("g1"), F.col("core").alias("g2"), "k1", "k2", "at", "single", "l", "r")

    few = bytes_of(asked.filter(F.col("n") <= group))
    parts = [_sorted_groups(few.withColumns({"shared": F.lit(reach.core), "least": F.lit(reach.least), "start": F.col("at"), "end": F.col("at")}))]
    many = asked.filter(F.col("n") > group)
    if not many.isEmpty():
        hot = written(bytes_of(many), "hot")
        for least in sorted({reach.least, reach.length}):
            parts += _parted(hot, reach, least, group)
    places = live.join(contexts.filter("settled").select("core", "u1", "u2"), ["core", "u1", "u2"]).select("k1", "k2", F.explode("at").alias("at"))
    both = places.select("k1", "k2", "at", F.lit(-1).alias("until"))
    for ranges in parts:
        both = both.union(ranges.toDF("k1", "k2", "at", "until"))
    return both.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "until")).alias("found"))  # at most a few for each anchor of one text


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _runs(n: int, copies: bool, found: list[dict] | None, reach: Reach, length: int) -> list[tuple[int, int]]:
    """The runs of a text of n bytes that repeated strings of ``length`` bytes cover."""
    if copies and n >= length:
        return [(0, n)]
    ranges = []
    for x in found or []:
        start, end = x["at"], x["until"]
        if end < 0:
            left, right = reach.around(start, n)
            start, end = start - left, start + right
        if end - start >= length:
            ranges.append((start, end))
    return merged(ranges)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = None, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (the removed runs, as pairs of places), kept (the remaining
    bytes) and passages (the runs that repeated strings of ``passage`` bytes cover, by default ``length``)."""
    named = _named(docs, key, text)
    reach = Reach(length, passage, window)
    copies = named.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2", F.lit(True).alias("copies"))
    with scope() as made:
        marks = written(repeated(named, reach, group).join(copies, ["k1", "k2"], "full"), "marks")
    erase(docs.sparkSession, made[:-1])

    def run(batches):
        pairs = lambda runs: pa.array([[list(x) for x in r] for r in runs], pa.list_(pa.list_(pa.int32())))
        for b in pieces(batches, "t"):
            texts = raw(b.column("t"))
            known = list(zip(map(len, texts), b.column("copies").to_pylist(), b.column("found").to_pylist()))
            runs = [_runs(*x, reach, length) for x in known]
            kept = [b"".join(t[a:b] for a, b in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(t)])) for t, r in zip(texts, runs)]
            yield {"doc_id": b.column("doc_id"), "n_bytes": [n for n, _, _ in known], "spans": pairs(runs), "kept": kept, "passages": pairs([_runs(*x, reach, reach.least) for x in known])}

    marked = _among(named, marks).join(marks, ["k1", "k2"], "left").select("doc_id", "t", "copies", "found")
    rest = _among(named, marks, others=True).select("doc_id", "t", F.lit(None).cast("boolean").alias("copies"), F.lit(None).cast(marks.schema["found"].dataType).alias("found"))
    return mapped(marked.union(rest), run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, spans array<array<int>>, kept binary, passages array<array<int>>")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_bytes: bytes in repeated strings of ``PASSAGE`` bytes or more."""
    found = spans(table(spark, sf_dir, "documents"), passage=PASSAGE)
    covered = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("passages").alias("n_passage_bytes"))
