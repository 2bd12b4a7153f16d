"""Document quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean expression over a document's text and words that is true when the
document is to be rejected. ``Cascade.fit`` estimates on a sample, the documents of the smallest
hash of id and text, what each rule costs a row and which documents it rejects. The cost is the
shortest of several runs over the sample, without that of the same job without a rule; quick rules
run over the sample many times. Rules are then picked one after the other, each time the one that
rejects most of what is left per second, those that reject nothing more by cost. The
verdict is one CASE expression in that order, so a document stops at the first rule that
rejects it. The order changes the cost only: a document is kept if no rule rejects it.

Defined results: null and empty texts have no words (all counts 0, so the base rules reject
them); texts of any length are read whole; rows with equal ids or equal texts are judged one by one;
rules of equal worth are tried in the order of their costs and then names; an empty table gives an
empty table and leaves the rules in their order; columns of the input other than the id and the text are not read by
``features`` and pass unchanged through ``keep``, whatever their names are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 8
#: White space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows on which ``Cascade.fit`` measures costs and rejections; they decide the order of rules only.
SAMPLE_ROWS = 500
#: Runs of each rule over the sample, and copies of the sample for rules quicker than QUICK seconds.
RUNS = 2
COPIES = 10
QUICK = 0.1


def words(text: Column) -> Column:
    """The text's words as an array; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def word_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _twins(ordered: Column) -> Column:
    """Positions ``i`` of the entries of a sorted array of (x, i) whose x occurs twice or more."""
    near = lambda e, k: F.coalesce(F.get(ordered, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["x"] == e["x"], F.lit(False))
    return F.transform(F.filter(ordered, near), lambda e: e["i"])


def repeated_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words found twice or more in the text.

    Hashes of the windows tell most texts from those with a repeat at once (equal windows
    have equal hashes); where hashes meet, the windows' own words decide.
    """
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = F.transform(F.array(words), lambda w: F.transform(F.array(hashes(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(WINDOW)))))[0])[0]

    def covered(hashed: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashed, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        texts = F.transform(F.array(by_hash), lambda s: F.transform(_twins(s), lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("x"), i.alias("i"))))[0]
        starts = F.transform(F.array(F.sort_array(texts)), lambda s: F.sort_array(_twins(s)))[0]
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, first, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])

    none = F.lit(0).cast("long")
    counted = F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none))[0]
    return F.when(F.size(words) > WINDOW, counted).otherwise(none)


class Document:
    """What rules read of a document: its text, its words and counts, which are computed in place
    unless they are given as columns."""

    def __init__(self, text: Column, words: Column, **counts: Column):
        self.text, self.words = text, words
        self.__dict__.update(counts)

    @cached_property
    def n_words(self) -> Column:
        return F.size(self.words)

    @cached_property
    def word_chars(self) -> Column:
        return word_chars(self.words)

    @cached_property
    def n_symbols(self) -> Column:
        return symbol_count(self.text)

    @cached_property
    def n_repeat_words(self) -> Column:
        return repeated_words(self.words)


@dataclass(frozen=True)
class Rule:
    """``rejects(document)``: true for a document to be rejected. ``seconds`` a row and ``rejected``, the
    share of the sample that it rejects and no earlier rule does, are measured by ``Cascade.fit``."""

    name: str
    rejects: Callable[[Document], Column]
    seconds: float = 0.0
    rejected: float = 0.0

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def _few_words(d: Document) -> Column:
    return d.n_words < 20


def _repetition(d: Document) -> Column:
    return d.n_repeat_words * 100 > d.n_words * 30


def _symbols(d: Document) -> Column:
    """More than 30 symbols for 100 words."""
    return d.n_symbols * 100 > d.n_words * 30


def _word_length(d: Document) -> Column:
    """A mean word of under 2 or over 20 characters."""
    return (d.word_chars < d.n_words * 2) | (d.word_chars > d.n_words * 20)


def _shouting(d: Document) -> Column:
    """More than 60 % of all characters are capital letters A-Z."""
    return F.char_length(F.regexp_replace(F.coalesce(d.text, F.lit("")), "[^A-Z]+", "")) * 100 > F.char_length(F.coalesce(d.text, F.lit(""))) * 60


def _line_copies(d: Document) -> Column:
    """More than 60 % of the lines repeat an earlier one."""
    lines = word_lines(d.text)
    return duplicate_lines(lines) * 100 > F.size(lines) * 60


def _no_letters(d: Document) -> Column:
    """More than 60 % of the characters in words are digits, ASCII punctuation or symbols."""
    return F.char_length(F.regexp_replace(F.array_join(d.words, ""), r"[^\x21-\x40\x5B-\x60\x7B-\x7E]+", "")) * 100 > d.word_chars * 60


#: The rules that the base counts decide, and the others.
BASE = (Rule("few_words", _few_words), Rule("repetition", _repetition))
FURTHER = (Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("shouting", _shouting), Rule("line_copies", _line_copies), Rule("no_letters", _no_letters))


def ordered(rules: list[Rule], rejects: list[list[bool]]) -> tuple[Rule, ...]:
    """The rules in the order in which they are to be tried; ``rejects`` has a row for each document
    of the sample. Picks the rule of the most rejections per second among the documents left."""
    left, out, waiting = list(rejects), [], dict(enumerate(rules))
    while waiting:
        hits = {i: sum(row[i] for row in left) / max(1, len(rejects)) for i in waiting}
        i = min(waiting, key=lambda i: (-hits[i] / max(waiting[i].seconds, 1e-9), waiting[i].seconds, waiting[i].name))
        out.append(replace(waiting.pop(i), rejected=hits[i]))
        left = [row for row in left if not row[i]]
    return tuple(out)


class Cascade:
    """Rules in the order in which they are tried."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + FURTHER):
        self.rules = tuple(rules)

    def fit(self, docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Cascade:
        """The same rules, in the order that costs and rejections on at most ``sample_rows`` rows suggest."""
        rows = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h")).orderBy("h").limit(sample_rows)
        sample = written(rows.select("t").coalesce(1), "sample").withColumn("w", words(F.col("t")))  # one task measures
        document = Document(F.col("t"), F.col("w"))
        rejects = [[bool(x) for x in r] for r in sample.select(*(r.rejects(document).alias(r.name) for r in self.rules)).collect()]
        if not rejects:
            return self

        def seconds(of: DataFrame, test: Column, runs: int = RUNS) -> float:
            times = []
            for _ in range(runs):
                job = of.agg(F.count_if(test))  # a new one each time: a job that has run keeps its results
                began = time.perf_counter()
                job.collect()
                times.append(time.perf_counter() - began)
            return min(times)

        many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
        empty = F.length("t") + F.size("w") < 0
        idle, idle_many = seconds(sample, empty, RUNS + 1), seconds(many, empty, RUNS + 1)
        measured = []
        for rule in self.rules:
            cost = (seconds(sample, rule.rejects(document)) - idle) / len(rejects)
            if cost * len(rejects) < QUICK:
                cost = (seconds(many, rule.rejects(document)) - idle_many) / (len(rejects) * COPIES)
            measured.append(replace(rule, seconds=max(cost, 1e-9)))
        return Cascade(ordered(measured, rejects))

    def verdict(self, text: Column, words: Column, **counts: Column) -> Column:
        """True if no rule rejects; later rules run only where earlier ones pass."""
        document, kept = Document(text, words, **counts), F.lit(True)
        for rule in reversed(self.rules):
            kept = F.when(rule.rejects(document), F.lit(False)).otherwise(kept)
        return kept

    def reason(self, text: Column, words: Column) -> Column:
        """The first rule that rejects, null for kept documents."""
        document, out = Document(text, words), F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.rejects(document), F.lit(rule.name)).otherwise(out)
        return out

    def keep(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``docs`` that no rule rejects, with their columns as they are."""
        # The words are bound to a variable, so that they are split once for a row and not in every rule.
        return docs.filter(F.transform(F.array(words(docs[text])), lambda w: self.verdict(docs[text], w))[0])


def features(docs: DataFrame, cascade: Cascade, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base counts of every document and the cascade's verdict where these do not reject it."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).withColumn("w", words(F.col("t"))).withColumn("lines", word_lines(F.col("t")))
    counted = rows.select(
        "doc_id", "t", "w",
        F.size("w").cast("long").alias("n_words"),
        word_chars(F.col("w")).alias("word_chars"),
        symbol_count(F.col("t")).alias("n_symbols"),
        duplicate_lines(F.col("lines")).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    judged = counted.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade.verdict(F.col("t"), F.col("w"), **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}))).drop("t", "w")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(docs, Cascade().fit(docs))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
f AS (SELECT w.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words FROM w LEFT JOIN hit USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 30 OR word_chars < n_words * 2 OR word_chars > n_words * 20
    OR length(regexp_replace(t, '[^A-Z]+', '', 'g')) * 100 > length(t) * 60 OR n_dup_lines * 100 > len(lines) * 60
    OR length(regexp_replace(array_to_string(w, ''), '[^\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) * 100 > word_chars * 60) AS kept
FROM b
"""
