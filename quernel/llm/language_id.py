"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code
point. A trigram's vector binds (multiplies) its letters' vectors, the first permuted twice
and the second once, so that order counts. A document's vector bundles (adds) its trigrams'
vectors; a language's prototype bundles the vectors of the documents that are known to be in
it, each weighted by the inverse of its length. A document takes the language whose prototype
has the largest cosine with its vector, of equal ones the first by name.

Letters are those of ``str.isalpha``, lower-cased; anything else parts words. Trigrams are bound and
bundled in blocks of ``BLOCK``, and texts read in segments of about ``SEGMENT`` characters that end
where a word does, so that memory is that of a block and a segment, whatever a text's length or
alphabet.

Defined results: a null text or one without letters is ``und`` with score 0, and so is every
text where nothing can be learned (no rows, or none with a language); texts are read whole, but a run of
more than two segments of letters is parted after each; rows are judged one by one, repeated ones too, and learned from as
often as they occur; an empty table gives an empty table; columns
other than id, text and the training language are not read, whatever their names are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, mapped, pieces, table

DIM = 1024
SEED = 20240229
#: Beyond this many possible trigrams of a slice's letters they are ranked by sorting.
DIRECT = 1 << 22
#: Trigrams that are bound at once, distinct ones of a slice that are bound once for all its texts, and characters in a segment.
BLOCK = 1 << 12
TABLE = 1 << 14
SEGMENT = 1 << 20
_BREAK = re.compile(r"[\W\d_]")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng(SEED + code).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)


class Trigrams:
    """The trigrams of a slice of texts: ``of[i]`` numbers the i-th trigram, ``start`` bounds the
    texts, and ``vectors`` has a row for each distinct trigram."""

    def __init__(self, texts: list[str]):
        texts = [f" {(t or '').lower()} " for t in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[np.flatnonzero(np.diff(doc, prepend=-1))] = True
        codes, doc = np.where(letter[keep], codes[keep], 0x20), doc[keep]
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        letters = np.flatnonzero(seen)
        rank = np.zeros(0x110000, np.int32)
        rank[letters] = np.arange(len(letters))
        r, k = rank[codes].astype(np.int64), len(letters)
        grams = (r[:-2] * k + r[1:-1]) * k + r[2:]
        blank = rank[0x20] if seen[0x20] else -1
        inside = (doc[:-2] == doc[2:]) & ((r[1:-1] != blank) | (r[:-2] != blank) | (r[2:] != blank))
        grams, doc = grams[inside], doc[:-2][inside]
        if k**3 <= DIRECT:
            present = np.zeros(k**3, bool)
            present[grams] = True
            distinct = np.flatnonzero(present)
            place = np.zeros(k**3, np.int32)
            place[distinct] = np.arange(len(distinct))
            self.of = place[grams]
        else:
            distinct, self.of = np.unique(grams, return_inverse=True)
        self.doc, self.start = doc, np.searchsorted(doc, np.arange(len(texts) + 1))
        self.letters, self.distinct = letters, distinct
        self.table = self._bound(np.arange(len(distinct))) if len(distinct) <= TABLE else None

    def _bound(self, used: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, by their numbers."""
        grams, k = self.distinct[used], len(self.letters)
        ranks, at = np.unique(np.stack([grams // (k * k), grams // k % k, grams % k]), return_inverse=True)
        if not len(ranks):
            return np.zeros((0, DIM), np.float32)
        one = np.stack([letter_vector(int(c)) for c in self.letters[ranks]])
        first, second, third = at.reshape(3, -1)
        return (np.roll(one, 2, 1)[first] * np.roll(one, 1, 1)[second] * one[third]).astype(np.float32)

    def _bundle(self, used: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(DIM, np.float64 if weights.dtype == np.float64 else np.float32)
        for i in range(0, len(used), BLOCK):
            part = used[i : i + BLOCK]
            out += weights[i : i + BLOCK] @ (self._bound(part) if self.table is None else self.table[part])
        return out

    def vector(self, i: int) -> np.ndarray | None:
        """The i-th text's bundle; null without letters."""
        own = self.of[self.start[i] : self.start[i + 1]]
        if not len(own):
            return None
        if len(self.distinct) > 4 * len(own):
            used, counts = np.unique(own, return_counts=True)
        else:
            counts = np.bincount(own)
            used = np.flatnonzero(counts)
            counts = counts[used]
        return self._bundle(used, counts.astype(np.float32))

    def bundles(self, groups: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """One bundle for each group of texts, every text weighted."""
        out = np.zeros((n, DIM))
        for g in range(n):
            mine = groups[self.doc] == g
            sums = np.bincount(self.of[mine], weight[self.doc[mine]], minlength=len(self.distinct))
            used = np.flatnonzero(sums)
            out[g] = self._bundle(used, sums[used])
        return out


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end where a word does."""
    at = 0
    while len(text) - at > 2 * size:
        found = _BREAK.search(text, at + size, at + 2 * size)
        end = found.start() if found else at + 2 * size
        yield text[at:end]
        at = end
    yield text[at:]


def read(texts: list[str]) -> Iterator[tuple[list[int], Trigrams]]:
    """The trigrams of texts, some segments at a time, with the number of the text of each segment."""
    owners: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        for x in segments(t or ""):
            if held and size + len(x) > 2 * SEGMENT:
                yield owners, Trigrams(held)
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(x)
            size += len(x)
    if held:
        yield owners, Trigrams(held)


def vectors(texts: list[str]) -> list[np.ndarray | None]:
    """Every text's bundle."""
    out: list[np.ndarray | None] = [None] * len(texts)
    for owners, grams in read(texts):
        for j, i in enumerate(owners):
            v = grams.vector(j)
            if v is not None:
                out[i] = v if out[i] is None else out[i] + v
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, of unit length, from all rows with a language.

    What reaches the driver is one vector for each language.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in pieces(batches, "t"):
            names = b.column("lang").to_pylist()
            order = {x: i for i, x in enumerate(dict.fromkeys(names))}
            texts, group = b.column("t").to_pylist(), np.array([order[x] for x in names])
            if max(map(len, texts)) > 2 * SEGMENT:  # a text's length is known when all of its segments are read
                size = np.zeros(len(texts))
                for owners, grams in read(texts):
                    np.add.at(size, owners, np.diff(grams.start))
            else:
                size = None
            for owners, grams in read(texts):
                length = np.diff(grams.start) if size is None else size[owners]
                for x, v in zip(order, grams.bundles(group[owners], 1.0 / np.maximum(length, 1), len(order))):
                    sums[x] = sums.get(x, 0) + v
        yield {"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"))
    sums = mapped(known, run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(DIM))[row["i"]] = row["x"]
    names = sorted(x for x, v in found.items() if np.any(v))
    return names, np.array([found[x] / np.linalg.norm(found[x]) for x in names], np.float32).reshape(len(names), DIM)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns ``also`` (Boolean), lang_pred and score of every row."""
    names, prototypes = model
    also = also or {}
    passed = tuple(also)

    def judge(v: np.ndarray | None) -> tuple[str, float]:
        if v is None or not names:
            return "und", 0.0
        cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-9)
        best = int(np.argmax(cosines))
        return names[best], float(min(1.0, max(0.0, cosines[best])))

    def run(batches):
        for b in pieces(batches, "t"):
            found = list(map(judge, vectors(b.column("t").to_pylist())))
            yield {"doc_id": b.column("k"), **{c: b.column(c) for c in passed}, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *(c.alias(n) for n, c in also.items()))
    return mapped(rows, run, f"doc_id {docs.schema[key].dataType.simpleString()}, {''.join(f'{c} boolean, ' for c in also)}lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    return predict(docs, fit(docs.filter(~out)), also={"held_out": out})
