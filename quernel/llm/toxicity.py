"""Toxicity by a weighted finite-state pattern grammar.

A text is split into clauses, and a clause into words. A lexical transducer reads words and
writes classes: insult (a fixed list, and word forms learned from labels), threat, target (words for a person), negation,
reporting verb, member of a family (an insult or other, see below) or other; phrases of several words are paths through it, beside the words' own. Three
transducers over classes are composed with each other (``compose``) and with it:

* *negation* marks insults and threats among the ``SCOPE`` words after a negation,
* *reported speech* marks those after a reporting verb, to the end of the clause,
* *target* has the weights: it guesses at an insult or threat that a target comes within ``REACH`` words, or
  remembers one from as many words before; a guess that is not met ends in no final state.

A clause's reading is the path of the largest weight, and its pattern the strongest symbol on it, such
as ``I-@``: an insult, negated, at a target. A document's score is the logistic function
of the sum, over its patterns, of weight times log(1 + clauses of the pattern): whole clauses count,
not single words.

Learned from at most ``TRAINING_ROWS`` labelled rows, those of the smallest hash of the id:

* insult forms, whole words or beginnings of 4 to 8 letters: those for which the texts that
  hold them are toxic far more often than texts are on the whole (a binomial tail bound
  over all forms that occur). A beginning is also looked at as a family: then its words count only in
  texts with two or more different ones of them, and one among ``APART`` words or more, so that a long text
  does not gather them by chance. Confirmed near copies of the same label count once there.
* the patterns' weights, by logistic regression with a normal prior around the grammar's own.

Defined results: null and empty texts match nothing and score as the intercept does; texts of any
length are read whole; labels
other than 0 and 1 and null labels or ids are not learned from; of different labels of one id the larger
counts, and every row of a labelled id is learned from; without labelled rows the
fixed lists and the prior decide; an empty table gives an empty table; paths of equal weight differ in nothing that
counts; rows are scored one by one; columns other than id and text
are not read, whatever their names are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, mapped, pieces, raw, table, written
from .near_duplicates import SHINGLE, SIMILARITY, components, shingle_set
from .quality_classifier import labelled_sample

TRAINING_ROWS = 20_000
#: Chance with which any learned form may be one by accident.
ACCIDENT = 0.05
#: Share of toxic texts among those with a learned form: this part of the way from the base rate to 1.
LEAST_LIFT = 0.95
#: Texts that must hold a form for it to be looked at, and the lengths of beginnings.
LEAST_TEXTS = 4
LENGTHS = (4, 5, 6, 7, 8)
#: Words of a text for each that begins as its family does, at most.
APART = 400

INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb jerk bastard coward parasite vermin idiote crétin imbécile connard salaud ordure dummkopf arschloch trottel abschaum versager idiota estúpido imbécil basura escoria".split())
THREATS = frozenset("kill hurt destroy beat stab shoot burn punish crush tuer frapper détruire töten schlagen vernichten umbringen matar golpear destruir".split())
TARGETS = frozenset("you your yours yourself u they them he him she her everyone tu toi vous ton votre du dich dir euch dein ihr tú usted ustedes vosotros ti".split())
NEGATIONS = frozenset("not no never neither nor without isn aren wasn don doesn didn ne pas jamais aucun sans nicht kein keine nie ohne nunca jamás sin tampoco".split())
REPORTS = frozenset("said says say called calls claimed claims wrote writes quoted quote reported reportedly according allegedly dit appelé écrit selon sagte nannte schrieb laut dijo llamó escribió según".split())

PHRASES = {"piece of trash": "I", "waste of space": "I", "go to hell": "I", "shut up": "I", "drop dead": "I", "going to get": "T", "will find": "T"}

#: Classes: insult, learned insult, threat; target, negation, report, member of a family that isn't met, other.
LOUD, QUIET = ("I", "F", "T"), ("Y", "N", "R", "G", "W")
#: Words after a negation that it marks, and words between a target and what is aimed at it.
SCOPE = 4
REACH = 6
_CLAUSES = re.compile(r"[^.!?;:\n]+").findall
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Transducer:
    """Weighted arcs (state, input) -> (output, weight, next state); weights add up along a path."""

    arcs: dict[tuple[int, str], tuple[tuple[str, float, int], ...]]
    finals: frozenset[int]
    start: int = 0

    def best(self, symbols) -> float | None:
        """The largest weight of a path that reads the symbols and ends in a final state."""
        active = {self.start: 0.0}
        for x in symbols:
            after: dict[int, float] = {}
            for state, weight in active.items():
                for _, w, to in self.arcs.get((state, x), ()):
                    after[to] = max(after.get(to, -math.inf), weight + w)
            active = after
        return max((w for s, w in active.items() if s in self.finals), default=None)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that writes what b writes when it reads what a writes; a state is one of each."""
    numbers, waiting = {(a.start, b.start): 0}, [(a.start, b.start)]
    leaving: dict[int, list] = {}
    for (state, x), arcs in a.arcs.items():
        leaving.setdefault(state, []).append((x, arcs))
    out: dict[tuple[int, str], list] = {}
    while waiting:
        s, t = waiting.pop()
        for x, arcs in leaving.get(s, ()):
            for written, w, to in arcs:
                for o, v, then in b.arcs.get((t, written), ()):
                    if (to, then) not in numbers:
                        numbers[to, then] = len(numbers)
                        waiting.append((to, then))
                    out.setdefault((numbers[s, t], x), []).append((o, w + v, numbers[to, then]))
    finals = frozenset(n for (s, t), n in numbers.items() if s in a.finals and t in b.finals)
    return Transducer({k: tuple(v) for k, v in out.items()}, finals)


def negation() -> Transducer:
    """State k: the next k words are in a negation's scope."""
    arcs = {}
    for k in range(SCOPE + 1):
        for x in (*LOUD, *QUIET):
            out = x + "-" if k and x in LOUD else x
            arcs[k, x] = ((out, 0.0, SCOPE if x == "N" else max(0, k - 1)),)
    return Transducer(arcs, frozenset(range(SCOPE + 1)))


def reported() -> Transducer:
    """State 1: a reporting verb was read."""
    arcs = {}
    for k in (0, 1):
        for x in (*LOUD, *(x + "-" for x in LOUD), *QUIET):
            arcs[k, x] = ((x + "~" if k and x[0] in LOUD else x, 0.0, 1 if x == "R" else k),)
    return Transducer(arcs, frozenset((0, 1)))


def weight_of(pattern: str) -> float:
    """The grammar's own weight of a symbol that the composed machine writes."""
    aimed = "@" in pattern
    w = (2.0 if aimed else 0.0) if pattern[0] == "T" else 2.5 if aimed else 2.0
    return w * (0.3 if "-" in pattern else 1.0) * (0.5 if "~" in pattern else 1.0)


PATTERNS = tuple(x + n + r + t for x in LOUD for n in ("", "-") for r in ("", "~") for t in ("", "@") if weight_of(x + n + r + t) > 0)
PRIOR = np.array([weight_of(p) for p in PATTERNS])
INTERCEPT = -2.5


def target() -> Transducer:
    """States 0 to REACH: so many words yet in which a target that was read is near. States beyond:
    an insult or threat waits for its target, so many words yet."""
    loud = [x + n + r for x in LOUD for n in ("", "-") for r in ("", "~")]
    arcs: dict[tuple[int, str], tuple] = {}
    for k in range(2 * REACH + 1):
        wait = k - REACH if k > REACH else 0
        for x in (*loud, *QUIET):
            if x == "Y":
                arcs[k, x] = ((x, 0.0, REACH),)
                continue
            if wait:
                then = (k - 1,) if wait > 1 else ()
            else:
                then = (max(0, k - 1),)
            if x in QUIET:
                found = [(x, 0.0, to) for to in then]
            elif k and not wait:
                found = [(x + "@", weight_of(x + "@"), to) for to in then]
            elif wait:  # what is guessed for one is for the next one, too
                found = [(x + "@", weight_of(x + "@"), to) for to in then]
            else:
                found = [(x, weight_of(x), 0), (x + "@", weight_of(x + "@"), 2 * REACH)]
            arcs[k, x] = tuple(found)
    return Transducer(arcs, frozenset(range(REACH + 1)))


MACHINE = compose(compose(negation(), reported()), target())


def _phrases(phrases: dict[str, str]) -> tuple[dict[tuple[int, str], int], dict[tuple[int, str], str], set[str]]:
    """The paths of phrases through the lexical transducer: (state, word) -> state, and -> class where
    one ends; and a word of each, without which it can't be there."""
    steps: dict[tuple[int, str], int] = {}
    ends: dict[tuple[int, str], str] = {}
    for phrase, kind in phrases.items():
        state, words = 0, phrase.split()
        for w in words[:-1]:
            state = steps.setdefault((state, w), len(steps) + 1)
        ends[state, words[-1]] = kind
    return steps, ends, {max(p.split(), key=len) for p in phrases}


STEPS, ENDS, MARKS = _phrases(PHRASES)


@dataclass(frozen=True)
class Grammar:
    learned: frozenset[str] = frozenset()

    def symbol(self, word: str) -> str:
        """The class of a word by itself."""
        if word in INSULTS:
            return "I"
        if self.learned and (word in self.learned or any(word[:n] + "*" in self.learned for n in LENGTHS)):
            return "F"
        for kind, words in (("T", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            if word in words:
                return kind
        return "G" if self.learned and any(word[:n] + "**" in self.learned for n in LENGTHS) else "W"

    def gathered(self, words: Counter, known: dict[str, str]) -> set[str]:
        """Words of those families (class G) that are met in a text of these words."""
        alike = {w: [w[:n] for n in LENGTHS if len(w) >= n and w[:n] + "**" in self.learned] for w in words if self._symbol(w, known) == "G"}
        met = families(words, alike) if alike else set()
        return {w for w, beginnings in alike.items() if not met.isdisjoint(beginnings)}

    def lexical(self, state: int, word: str, known: dict[str, str]) -> list[tuple[str, int]]:
        """Arcs (class, next state) of the lexical transducer: the word's own, and those of phrases."""
        out = [(self._symbol(word, known), 0)] if state == 0 else []
        if (to := STEPS.get((state, word))) is not None:
            out.append((self._symbol(word, known), to))
        if (kind := ENDS.get((state, word))) is not None:
            out.append((kind, 0))
        return out

    def clause(self, words: list[str], known: dict[str, str]) -> tuple[float, str]:
        """Weight and pattern of the best path, of the lexical transducer composed with ``MACHINE`` as it is read."""
        active: dict[tuple[int, int], tuple[float, float, str]] = {(0, MACHINE.start): (0.0, 0.0, "")}
        for word in words:
            after: dict[tuple[int, int], tuple[float, float, str]] = {}
            for (s, t), (weight, top, pattern) in active.items():
                for x, to in self.lexical(s, word, known):
                    for out, w, then in MACHINE.arcs.get((t, x), ()):
                        new = (weight + w, w, out) if w > top else (weight + w, top, pattern)
                        if new > after.get((to, then), (-1.0,)):
                            after[to, then] = new
            active = after
        return max(((weight, pattern) for (s, t), (weight, _, pattern) in active.items() if s == 0 and t in MACHINE.finals), default=(0.0, ""))

    def patterns(self, text: str | None, known: dict[str, str]) -> Counter:
        """How many clauses have each pattern. ``known`` remembers the classes of words."""
        found: Counter = Counter()
        text = (text or "").lower()
        counts = Counter(_WORDS(text))
        loud = {w for w in counts if self._symbol(w, known) in LOUD or w in MARKS}
        if gathered := self.gathered(counts, known):
            loud |= gathered
            known = {w: self._symbol(w, known) for w in counts} | dict.fromkeys(gathered, "F")
        if not loud:
            return found
        for clause in _CLAUSES(text):
            words = _WORDS(clause)
            if not loud.isdisjoint(words):
                weight, pattern = self.clause(words, known)
                if weight > 0:
                    found[pattern] += 1
        return found

    def _symbol(self, word: str, known: dict[str, str]) -> str:
        symbol = known.get(word)
        if symbol is None:
            if len(known) >= 300_000:
                known.clear()
            symbol = known[word] = self.symbol(word)
        return symbol


def families(words: Counter, beginnings: dict[str, list[str]]) -> set[str]:
    """Beginnings of two or more different words that are one in ``APART`` words or more."""
    kinds, rows = Counter(), Counter()
    for w, of in beginnings.items():
        for b in of:
            kinds[b] += 1
            rows[b] += words[w]
    total = words.total()
    return {b for b, k in kinds.items() if k >= 2 and rows[b] * APART >= total}


def forms(words: Counter) -> set[str]:
    """Words, beginnings (``abcd*``) and families (``abcd**``) of a text."""
    beginnings = {w: [w[:n] for n in LENGTHS if len(w) >= n] for w in words}
    return {w for w in words if len(w) >= 3} | {b + "*" for of in beginnings.values() for b in of} | {b + "**" for b in families(words, beginnings)}


def without_copies(train: DataFrame) -> DataFrame:
    """(t, y) of rows (k, t, y) that are no near copy of another of their label, which is there.

    Equal texts are one row. Of each component of near-duplicates the text of the smallest digest
    stays, and of the others those that exact Jaccard similarity doesn't confirm as its copies.
    """
    rows = written(train.groupBy(F.md5("t").alias("r"), "y").agg(F.first("t").alias("t")), "labelled")
    parts = components(rows.select("r", "t").dropDuplicates(["r"]), key="r", text="t").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    parted = written(rows.join(parts, "r").select("r", "y", "c"), "parted")
    first = parted.groupBy("c", "y").agg(F.min("r").alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = written(parted.join(first, ["c", "y"]).filter("r != f").select("r", "y", "f"), "copies")
    both = pairs.join(rows, ["r", "y"]).join(rows.select(F.col("r").alias("f"), "y", F.col("t").alias("of")), ["f", "y"])

    def confirm(batches):
        for b in pieces(batches, "t"):
            sets = [[shingle_set(t, SHINGLE) for t in raw(b.column(c))] for c in ("t", "of")]
            same = [len(np.intersect1d(x, z, assume_unique=True)) for x, z in zip(*sets)]
            gone = [i for i, (n, x, z) in enumerate(zip(same, *sets)) if n * 100 >= SIMILARITY * (len(x) + len(z) - n)]
            yield {c: b.column(c).take(pa.array(gone, pa.int64())) for c in ("r", "y")}

    gone = written(mapped(both.select("r", "y", "t", "of"), confirm, "r string, y int"), "gone")
    return rows.join(gone, ["r", "y"], "left_anti").select("t", "y")


def covering(form: str) -> set[str]:
    """Forms of every text that holds this one, other than itself."""
    stem = form.rstrip("*")
    shorter = {stem[:n] for n in LENGTHS if n <= len(stem)}
    family = form.endswith("**")
    return ({b + "*" for b in shorter} | ({b + "**" for b in shorter} if family else set())) - {form}


def learn_forms(train: DataFrame) -> frozenset[str]:
    """Insult forms from rows (k, t, y); near copies count once."""

    def count(batches):
        seen = (Counter(), Counter())
        rows = [0, 0]
        for b in pieces(batches, "t"):
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
                rows[y] += 1
                seen[y].update(forms(Counter(_WORDS(t.lower()))))
        every = ["", *(set(seen[0]) | set(seen[1]))]
        yield {"form": every, "clean": [rows[0], *(seen[0][f] for f in every[1:])], "toxic": [rows[1], *(seen[1][f] for f in every[1:])]}

    counted = mapped(without_copies(train), count, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    counted = written(counted, "forms")
    total = counted.filter("form = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return frozenset()
    base, n_forms = total["toxic"] / (total["toxic"] + total["clean"]), counted.count()
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    good = counted.filter("form != '' and toxic > 0").filter(share > base + (1 - base) * LEAST_LIFT).filter((F.col("toxic") + F.col("clean")) * gain > math.log(n_forms / ACCIDENT))
    found = {r["form"] for r in good.select("form").collect()}  # bounded by the training rows
    return frozenset(f for f in found if not found & covering(f))


@dataclass(frozen=True)
class Model:
    grammar: Grammar = Grammar()
    weights: tuple[float, ...] = tuple(PRIOR)
    intercept: float = INTERCEPT

    def score(self, patterns: Counter) -> float:
        x = self.intercept + sum(self.weights[PATTERNS.index(p)] * math.log1p(n) for p, n in patterns.items())
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, x))))


def learn_weights(rows: list[tuple[Counter, int]], strength: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Gradient ascent on the posterior; the weights' normal prior is centred at ``PRIOR``."""
    x = np.zeros((len(rows), len(PATTERNS)))
    for i, (patterns, _) in enumerate(rows):
        for p, n in patterns.items():
            x[i, PATTERNS.index(p)] = math.log1p(n)
    y = np.array([y for _, y in rows], float)
    w, b = PRIOR.copy(), INTERCEPT
    curve = 0.25 * (x * x).sum(0) + strength
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        w += 0.5 * (x.T @ (y - p) - strength * (w - PRIOR)) / curve
        b += 0.5 * float((y - p).sum()) / (0.25 * len(rows) + 1)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> Model:
    sample = F.broadcast(labelled_sample(labels, label, key, rows))  # at most ``rows`` rows of 12 bytes
    train = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k")
    grammar = Grammar(learn_forms(train))

    def match(batches):
        known: dict[str, str] = {}
        for b in pieces(batches, "t"):
            found = [grammar.patterns(t, known) for t in b.column("t").to_pylist()]
            yield {"y": b.column("y"), "found": pa.array([list(c) for c in found], pa.list_(pa.string())), "counts": pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))}

    got = mapped(train, match, "y int, found array<string>, counts array<int>").toArrow().to_pylist()  # one small row for each training row
    if not got:
        return Model(grammar)
    weights, intercept = learn_weights([(Counter(dict(zip(r["found"], r["counts"]))), r["y"]) for r in got])
    return Model(grammar, tuple(weights.tolist()), float(intercept))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns ``also`` (Boolean), score, predicted and the number of matched clauses of every row."""
    also = also or {}
    passed = tuple(also)

    def run(batches):
        known: dict[str, str] = {}
        for b in pieces(batches, "t"):
            found = [model.grammar.patterns(t, known) for t in b.column("t").to_pylist()]
            scores = list(map(model.score, found))
            yield {"doc_id": b.column("k"), **{c: b.column(c) for c in passed}, "score": scores, "predicted": [int(s >= threshold) for s in scores], "n_clauses": [sum(c.values()) for c in found]}

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *(c.alias(n) for n, c in also.items()))
    return mapped(rows, run, f"doc_id {docs.schema[key].dataType.simpleString()}, {''.join(f'{c} boolean, ' for c in also)}score double, predicted int, n_clauses long")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.filter(~held_out("doc_id", 4, 2))), also={"held_out": held_out("doc_id", 4, 2)})
