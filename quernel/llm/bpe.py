"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be bridged by
a merge, so such a pair is a certain cut. A text is split at its special tokens, then by the
vocabulary's word pattern, then at every certain cut; each fragment is encoded on its own and
the ids are put side by side. That equals merging over the whole word, because merges on the
two sides of a cut never touch. Encoded fragments are remembered up to a fixed number.

Decoding puts the tokens' bytes side by side and reads them as UTF-8, replacing what is not.

Defined results: a null or empty text has no tokens and decodes to the empty text; rows are
encoded one by one, repeated ones too; an empty table gives an empty table; columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, pieces, table

#: Remembered words; the memory is emptied when full.
REMEMBERED = 500_000
#: Fragments of more bytes are merged with a queue.
LONG = 100
#: A merge is its rank, from 1, above its new id.
SHIFT = 24
ID = (1 << SHIFT) - 1
NO_MERGE = 1 << 60
#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable
    Latin-1 bytes for themselves, the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token: dict[int, bytes] = {i: to_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token.update({i: t.encode() for t, i in self.special.items()})
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        none: dict[int, int] = {}
        self.merges: list[dict[int, int]] = [none] * (max(self.token) + 1)  # by left id: right id -> rank and new id
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            if self.merges[vocab[a]] is none:
                self.merges[vocab[a]] = {}
            self.merges[vocab[a]][vocab[b]] = rank + 1 << SHIFT | vocab[a + b]
        inside = {p for i in vocab.values() for p in zip(self.token[i], self.token[i][1:])}
        self.outside = frozenset((x, y) for x in range(256) for y in range(256)) - inside
        self.words = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text = {i: str(i) for i in self.token}
        self.known: dict[str, tuple[int, ...]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """The word, cut wherever a byte pair lies inside no token."""
        outside = self.outside
        if outside.isdisjoint(zip(word, word[1:])):
            return [word]
        cuts = [0, *(i for i, p in enumerate(zip(word, word[1:]), 1) if p in outside)]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def merge(self, fragment: bytes) -> list[int]:
        """The fragment's ids: the pair of the lowest rank first, of equal ones the leftmost."""
        single, merges = self.single, self.merges
        ids = [single[b] for b in fragment]
        if len(ids) > LONG:
            return self._merge_long(ids)
        pairs = [merges[a].get(b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == NO_MERGE:
                break
            i = pairs.index(best)
            new = ids[i] = best & ID
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merges[ids[i - 1]].get(new, NO_MERGE)
            if i < len(pairs):
                pairs[i] = merges[new].get(ids[i + 1], NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, with a queue of pairs over a linked list."""
        merges, n = self.merges, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges[ids[i]].get(ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            best, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = best & ID, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges[ids[x]].get(ids[y])):
                    heapq.heappush(queue, (m, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        got = tuple(chain.from_iterable(map(self.merge, self.fragments(word.encode()))))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) < 100:
            self.known[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                words, known = self.words(part), self.known.get
                parts = list(map(known, words))
                if None in parts:
                    parts = [known(w) or self.word(w) for w in words]
                out.extend(chain.from_iterable(parts))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.text.__getitem__, ids)).encode()).hexdigest()


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryBPE:
    """One coder for each Python worker."""
    return ForcedBoundaryBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its token ids, as ``ids array<int>``."""

    def run(batches):
        c = coder(path or default_path())
        for b in pieces(batches, "t"):
            yield {"doc_id": b.column("k"), "ids": [c.encode(t or "") for t in b.column("t").to_pylist()]}

    return mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row the text of its token ids; null ids give the empty text."""

    def run(batches):
        c = coder(path or default_path())
        for b in batches:
            yield {"doc_id": b.column("k"), "text": [c.decode(x or []) for x in b.column("i").to_pylist()]}

    return mapped(encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")), run, f"doc_id {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes: the number of ids and digests of the ids and of the decoded text."""

    def run(batches):
        c = coder(path or default_path())
        for b in pieces(batches, "t"):
            ids = [c.encode(t or "") for t in b.column("t").to_pylist()]
            yield {"doc_id": b.column("k"), "n_tokens": list(map(len, ids)), "ids_sha256": list(map(c.digest, ids)), "decoded_sha256": [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids]}

    return mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
