"""URL filters: explicit rules, then naive Bayes over segmented host and path words.

A rule blocks or allows a host with all its subdomains, for paths with a given beginning; of the
rules that fit a URL the longest decides. Where none fits, the method does:

* *Segmentation*: host labels and path words are split into words by unigram Viterbi. Word counts come from path
  words, once for each different host that does not hold the word itself, and from the fixed lists
  below: a label's own hosts do not make it a word. A label of which a part would be no known word
  stays whole, whatever its length. Words are letters and digits of any script; whole numbers are one token.
* *Naive Bayes*: the verdicts of the rules are the labels. The different hosts and path words that a rule judged are
  examples of its verdict, so that a rule's hosts teach what their words mean elsewhere; the
  rules' own words (``com``, ``en``) are no features, as they would only repeat the rules. The words of the lists
  are pseudo-counts of a class. What no rule judged takes part with the class probabilities
  that the model gives it, in ``ROUNDS`` rounds of expectation-maximisation. Classes weigh the same and ``PRIOR``
  says how rare *block* is; words that no example has say nothing.

Word counts are exact: they stay a table, which is joined with the pieces of the different labels. A
count-min sketch of a fixed size, which never counts too low, only tells which pieces need not be
looked up. The lists' words have half of all weight at least, however many words there are. The
Bayes model has a fixed size (hashed buckets).

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
scored as an empty set of tokens (*allow*); a score of 0 is *allow*; of equally long rules one that blocks decides; URLs of any length
are read whole; rows are judged one by one, repeated ones too; an empty table
gives an empty table; columns other than id and URL are not read, whatever their names are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, written

#: (verdict, host, beginning of the path), as the filter is used here.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

STRONG = frozenset("adult spam casino casinos bet bets betting poker gambling slots jackpot lottery roulette viagra cialis pill pills pharmacy porn porno xxx sex escort escorts payday warez torrent torrents malware phishing replica".split())
WEAK = frozenset("free win winner cheap ad ads adserver track tracker tracking click clicks bonus deal deals loan loans promo banner popup hot buy discount prize earn cash".split())
COMMON = frozenset("the and for of to in on my your our best top online shop store news blog home house garden book books game games music video photo web site world life travel health food sport sports school city local daily star green blue red new old art tech data cloud smart media press times post mail bank car auto page pages info work job jobs kids baby pet dog cat".split())

#: WIDTH is a power of two, so that signed and unsigned hashes have the same remainder.
ROWS, WIDTH = 3, 1 << 16
BUCKETS = 1 << 18
#: Characters of the longest part that a label is split into.
LONGEST = 24
ALPHA = 0.05
#: Pseudo-counts of the lists' words; log odds of *block* before anything is read.
SEEDS = ((STRONG, 1, 2.0), (WEAK, 1, 0.3), (COMMON, 0, 1.0))
PRIOR = math.log(0.1 / 0.9)
#: Weight of what no rule judged, and rounds in which its classes are estimated.
UNJUDGED = 0.2
ROUNDS = 2
#: Least weight of a word of the lists, and count from which another is known.
LISTED = 50.0
LEAST = 2
LISTS = STRONG | WEAK | COMMON

_URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.match(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


class Rules:
    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones one that blocks."""
        best, at = None, 0
        while host:
            suffix = host[at:]
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    fit = (len(suffix) + len(start), verdict == "block", suffix + start, verdict)
                    best = max(best, fit) if best else fit
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best and (best[2], best[3])


@dataclass(frozen=True)
class Words:
    """A count-min sketch of word counts; the lists' words have ``weight`` more."""

    counts: np.ndarray
    total: float
    weight: float = LISTED

    def asked(self, label: str) -> set[str]:
        """The pieces of a label whose counts matter and may be more than 0."""
        found = {label[at:end] for at in range(len(label)) for end in range(at + 1, min(len(label), at + LONGEST) + 1) if end - at > 1 or len(label) == 1}
        return {w for w in found if (most := self._most(w)) and (most >= LEAST or w in LISTS)}

    def _most(self, word: str) -> float:
        return min(self.counts[r, xxhash.xxh64_intdigest(f"{r}{word}", seed=42) % WIDTH] for r in range(ROWS))

    def segment(self, label: str, exact: dict[str, int] | None = None) -> tuple[str, ...]:
        """The likeliest split into known words by their exact counts, or the label itself."""
        n, exact = len(label), exact or {}
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - LONGEST), end):
                if best[start][0] == -math.inf or (end - start < 2 and n > 1):
                    continue
                word = label[start:end]
                c = self.weight * (word in LISTS) + exact.get(word, 0)
                if c >= LEAST:
                    p = best[start][0] + math.log(c / self.total)
                    if p > best[end][0]:
                        best[end] = (p, start)
        if not n or best[n][0] == -math.inf:
            return (label,) if label else ()
        out, end = [], n
        while end:
            out.append(label[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(out))


_LETTERS = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; a whole number is ``0``."""
    return ["0" if w.isdecimal() else w for w in _LETTERS(text.lower())]


def own_words(rules) -> frozenset[str]:
    """The words that rules name."""
    return frozenset(w for _, host, path in rules for w in words_of(f"{host} {path}"))


def read_urls(pages: DataFrame, rules, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, labels (words of the host), words (of the path, parted by spaces), and the rule and its verdict."""

    def run(batches):
        found = Rules(rules)
        for b in batches:
            parts = [split_url(u) for u in b.column("u").to_pylist()]
            fits = [found.find(*x) or (None, None) for x in parts]
            yield {"page_id": b.column("k"), "host": [h for h, _ in parts], "path": [p for _, p in parts], "labels": [words_of(h) for h, _ in parts], "words": [" ".join(words_of(p)) for _, p in parts], "rule": [r for r, _ in fits], "verdict": [v for _, v in fits]}

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    return mapped(rows, run, f"page_id {pages.schema[key].dataType.simpleString()}, host string, path string, labels array<string>, words string, rule string, verdict string")


def fit_words(kinds: DataFrame) -> tuple[Words, DataFrame]:
    """Counts (w, n) of path words from the different (host, path words), a word's hosts without
    those that hold it, and their sketch."""
    paths = kinds.select("host", F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    counted = written(paths.filter("w != '' AND w != '0' AND NOT contains(host, w)").distinct().groupBy("w").agg(F.count("*").alias("n")), "words")
    cells = counted.select("n", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.pmod(F.xxhash64(F.concat(F.lit(str(r)), "w")), F.lit(WIDTH)).cast("int").alias("b")) for r in range(ROWS)))).alias("c"))
    got = cells.groupBy("c.r", "c.b").agg(F.sum("n").alias("n")).toArrow()  # at most ROWS * WIDTH
    counts = np.zeros((ROWS, WIDTH))
    counts[got["r"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    weight = max(LISTED, float(counts[0].sum()) / len(LISTS))
    return Words(counts, float(counts[0].sum()) + weight * len(LISTS), weight), counted


def split_names(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, names) and (words, path_names): the words of each different host and path, in order, their labels split."""
    words, counted = fit_words(kinds)
    shared = kinds.sparkSession.sparkContext.broadcast(words)
    of_hosts = kinds.select("host", "labels").distinct().select("host", F.posexplode("labels").alias("p", "label"))
    of_paths = kinds.select("words").distinct().select("words", F.posexplode(F.split("words", " ")).alias("p", "label")).filter("label != ''")
    # Pieces go with a label's digest, as labels may be long.
    labels = written(of_hosts.select("label").union(of_paths.select("label")).distinct().withColumn("g", F.md5("label")), "labels")

    def ask(batches):
        for b in batches:
            for g, label in zip(b.column("g").to_pylist(), b.column("label").to_pylist()):
                if found := sorted(shared.value.asked(label)):
                    yield {"g": [g] * len(found), "w": found}

    def split(batches):
        for b in batches:
            labels = b.column("label").to_pylist()
            yield {"label": labels, "names": [list(shared.value.segment(x, {e["w"]: e["n"] for e in found or ()})) for x, found in zip(labels, b.column("found").to_pylist())]}

    # Tables of their own before joins, so that Spark can split the joins' hot keys.
    found = written(mapped(labels, ask, "g string, w string"), "pieces").join(counted, "w").groupBy("g").agg(F.collect_list(F.struct("w", "n")).alias("found"))  # at most LONGEST for each letter
    parted = written(mapped(labels.join(found, "g", "left").select("label", "found"), split, "label string, names array<string>"), "segments")

    def named(of: DataFrame, key: str, name: str) -> DataFrame:
        whole = of.join(parted, "label").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("p", "names"))).alias("e"))
        return written(whole.select(key, F.flatten("e.names").alias(name)), name)

    return named(of_hosts, "host", "names"), named(of_paths, "words", "path_names")


_OWN = {w: BUCKETS + i for i, w in enumerate(sorted(LISTS))}
SIZE = BUCKETS + len(_OWN)


@lru_cache(maxsize=200_000)
def _bucket(token: str) -> int:
    """The lists' words have buckets of their own, so that no other word is taken for one."""
    return _OWN[token] if token in _OWN else xxhash.xxh3_64_intdigest(token) % BUCKETS


@dataclass(frozen=True)
class Bayes:
    """Log odds of *block* for each bucket; ``ignored`` words are no features."""

    odds: np.ndarray
    ignored: frozenset[str] = frozenset()

    def buckets(self, names: list[str] | None, path_names: list[str] | None) -> list[int]:
        """Those of the words of host and path; a word is the same feature in both."""
        return [_bucket(w) for w in (*(names or ()), *(path_names or ())) if w not in self.ignored]

    def score(self, buckets: list[int]) -> float:
        return PRIOR + float(self.odds[buckets].sum())


def token_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds by bucket from the counts (allow, block) of examples, scaled to the same total, and the lists."""
    total = counts.sum(1)
    if total.all():
        counts = counts * (total.min() / total)[:, None]
    counts = counts.copy()
    for words, y, n in SEEDS:
        for w in words:
            counts[y, _bucket(w)] += n
    size = max(1, np.count_nonzero(counts.sum(0)))
    logs = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * size)
    return np.where(counts.sum(0) > 0, logs[1] - logs[0], 0.0)


def fit_bayes(kinds: DataFrame, rules) -> Bayes:
    """From rows (names, path_names, verdict), one for each different URL's words and verdict."""
    ignored = own_words(rules)
    context = kinds.sparkSession.sparkContext

    def learned(model: Bayes | None) -> Bayes:
        shared = context.broadcast(model or Bayes(np.zeros(SIZE), ignored))
        judged_only = model is None

        def run(batches):
            bayes = shared.value
            for b in batches:
                sums = np.zeros((2, SIZE))
                for names, paths, verdict in zip(*(b.column(c).to_pylist() for c in ("names", "path_names", "verdict"))):
                    if verdict is None and judged_only:
                        continue
                    found = bayes.buckets(names, paths)
                    if verdict is None:
                        block = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, bayes.score(found)))))
                        both = (UNJUDGED * (1.0 - block), UNJUDGED * block)
                    else:
                        both = (float(verdict == "allow"), float(verdict == "block"))
                    for y in (0, 1):
                        np.add.at(sums[y], found, both[y])
                used = np.flatnonzero(sums.sum(0))
                yield {"k": used.tolist(), "allow": sums[0, used].tolist(), "block": sums[1, used].tolist()}

        got = mapped(kinds, run, "k int, allow double, block double").groupBy("k").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toArrow()  # at most SIZE rows
        counts = np.zeros((2, SIZE))
        counts[:, got["k"].to_numpy()] = np.stack([got["allow"].to_numpy(), got["block"].to_numpy()])
        return Bayes(token_odds(counts), ignored)

    model = learned(None)
    for _ in range(ROUNDS):
        model = learned(model)
    return model


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and, where the method decides, its log odds."""
    urls = written(read_urls(pages, rules, key, url), "urls")
    kinds = written(urls.select("host", "labels", "words", "verdict").distinct(), "url-kinds")
    hosts, paths = split_names(kinds)
    model = fit_bayes(written(kinds.join(hosts, "host", "left").join(paths, "words", "left").select("names", "path_names", "verdict"), "examples"), rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        bayes = shared.value
        for b in batches:
            scores = [None if verdict else bayes.score(bayes.buckets(names, found)) for names, found, verdict in zip(*(b.column(c).to_pylist() for c in ("names", "path_names", "verdict")))]
            verdicts = [verdict or ("block" if score > 0 else "allow") for verdict, score in zip(b.column("verdict").to_pylist(), scores)]
            yield {**{c: b.column(c) for c in ("page_id", "host", "path", "rule")}, "verdict": verdicts, "score": scores}

    rows = urls.join(hosts, "host", "left").join(paths, "words", "left").select("page_id", "host", "path", "rule", "verdict", "names", "path_names")
    return mapped(rows, run, f"page_id {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
