"""Line deduplication by a log-template tree, in DataFrame functions only.

Single spaces part a trimmed line into tokens. Tokens that hold a digit, an ``@`` or ``://`` are variable fields, ``<*>``. The tree has a fixed
depth: a line goes to the leaf of its number of tokens and its first ``LEADING`` tokens. Within a
leaf, a token is constant at its place if lines of ``LEAST_DOCS`` documents or more have it there;
others are variable fields too. A line of which ``CONSTANT`` hundredths or more are constant has
these constants and ``<*>`` as its template, any other line is its own template. A template found
in ``LEAST_DOCS`` documents or more recurs: its lines are dropped from all of them but the one of
the smallest id, so that one copy of everything stays.

Leaves are counted first (once for each document, before the shuffle), and only lines of leaves
that can hold a recurring template go further; places and tokens are counted over the leaf's
different lines, weighted by their documents. No step gathers the lines of a leaf or template.

Defined results: lines of fewer than ``LEAST_TOKENS`` tokens and blank lines always stay; a null
text stays null, with 0 lines; rows of the same id and text are one document; a null id counts as
the smallest; of documents of one id the text of the smaller hash is first; texts and lines of any
length are read whole; an empty table gives an empty table; extra columns pass unchanged through
``dedup_lines``, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .quality_rules import SPACES

LEADING = 3
LEAST_TOKENS = 3
LEAST_DOCS = 8
CONSTANT = 70
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(SPACES)), " ")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9@]|://"), F.lit(FIELD)).otherwise(t))


def _leaf(line: Column) -> Column:
    """The leaf's number; null for a line that always stays."""
    number = lambda w: F.when(F.size(w) >= LEAST_TOKENS, F.xxhash64(F.size(w), _masked(F.slice(w, 1, LEADING))))
    return F.transform(F.array(_tokens(line)), number)[0]  # the line is split once


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, k1, k2): id, text and 128 bits of hash of the text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.withColumns({"k1": F.xxhash64("t"), "k2": F.xxhash64(F.lit(LEADING), "t")})


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(k, k1, k2, gone): for each document that loses lines, their numbers."""
    rows = _identified(docs, key, text).filter("t IS NOT NULL")
    leaves = rows.select(F.explode(F.array_distinct(F.transform(F.split("t", "\n"), _leaf))).alias("leaf"))
    busy = written(leaves.filter("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("leaf"), "leaves")

    # The leaf is found inside the array: a filter on a column made after explode() would find it twice.
    parted = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"), _leaf(x).alias("leaf"))), lambda e: e["leaf"].isNotNull())
    lines = rows.select("k", "k1", "k2", F.explode(parted).alias("e")).select("k", "k1", "k2", "e.*")
    lines = lines.join(busy, "leaf").withColumn("tokens", _masked(_tokens(F.col("line"))))
    joined = F.array_join("tokens", " ")
    lines = written(lines.select("k", "k1", "k2", "i", "leaf", "tokens", F.xxhash64(joined).alias("l1"), F.xxhash64(F.lit(LEADING), joined).alias("l2")), "lines")

    document = F.struct("k", "k1", "k2")
    each = lines.groupBy("leaf", "l1", "l2", "k", "k1", "k2").agg(F.first("tokens").alias("tokens"))
    distinct = written(each.groupBy("leaf", "l1", "l2").agg(F.first("tokens").alias("tokens"), F.count("*").alias("docs")), "distinct")
    placed = distinct.select("leaf", "l1", "l2", "docs", F.posexplode("tokens").alias("p", "token"))
    constant = written(placed.groupBy("leaf", "p", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs).select("leaf", "p", "token", F.lit(True).alias("constant")), "constants")
    # The leading tokens are the leaf's own and constant; an overly common (place, token) is one row here.
    judged = placed.join(constant, ["leaf", "p", "token"], "left").withColumn("constant", (F.col("constant") | (F.col("p") < LEADING)) & (F.col("token") != FIELD))
    judged = judged.withColumn("constant", F.coalesce("constant", F.lit(False)))
    general = judged.groupBy("leaf", "l1", "l2").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(FIELD)).alias("x")))), lambda e: e["x"]).alias("general"), F.count_if("constant").alias("constants"), F.count("*").alias("n"))
    named = distinct.join(general, ["leaf", "l1", "l2"])
    template = F.array_join(F.when(F.col("constants") * 100 >= F.col("n") * CONSTANT, F.col("general")).otherwise(F.col("tokens")), " ")
    # A table of its own before it is joined, so that Spark can split the join's hot keys.
    named = written(named.select("leaf", "l1", "l2", F.xxhash64(template).alias("t1"), F.xxhash64(F.lit(LEADING), template).alias("t2")), "named")

    lines = written(lines.select("k", "k1", "k2", "i", "leaf", "l1", "l2").join(named, ["leaf", "l1", "l2"]).drop("l1", "l2"), "templates")
    seen = lines.groupBy("leaf", "t1", "t2", "k", "k1", "k2").agg(F.lit(1))
    recurring = written(seen.groupBy("leaf", "t1", "t2").agg(F.count("*").alias("docs"), F.min(document).alias("first")).filter(F.col("docs") >= least_docs).select("leaf", "t1", "t2", "first"), "recurring")
    gone = lines.join(recurring, ["leaf", "t1", "t2"]).filter(~document.eqNullSafe(F.col("first")))
    return gone.groupBy("k", "k1", "k2").agg(F.collect_set("i").alias("gone"))  # at most a document's lines


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, emptied: bool = True) -> DataFrame:
    """``docs`` with recurring lines dropped from the text. Without ``emptied``, documents that lose
    all their words go."""
    gone = dropped_lines(docs, key, text, least_docs).toDF("__k", "__k1", "__k2", "__gone")
    own = docs[text]
    same = docs[key].eqNullSafe(gone["__k"]) & (F.xxhash64(own) == gone["__k1"]) & (F.xxhash64(F.lit(LEADING), own) == gone["__k2"])
    both = docs.join(gone, same, "left")
    # The places that stay are found by hashing, so that the work is linear in the lines of a document.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["__gone"])
    left = F.transform(F.array(F.split(own, "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    rest = F.when(gone["__gone"].isNotNull(), left).otherwise(own)
    if not emptied:
        both = both.filter(gone["__gone"].isNull() | (F.btrim(rest, F.lit(SPACES)) != ""))
    return both.select(*(rest.alias(text) if c == text else docs[c] for c in docs.columns))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (lines with words), n_dropped and the digest of the remaining text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = dedup_lines(docs.withColumn("before", F.col("text")))
    lines = lambda t: F.coalesce(F.size(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")), F.lit(0)).cast("long")
    n = F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(lines(F.col("before")))
    return after.select("doc_id", n.alias("n_lines"), (n - F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(lines(F.col("text")))).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(coalesce(text, '')) AS k FROM documents),
a AS (SELECT r, doc_id, k, i, string_split(text, chr(10))[i] AS line FROM (SELECT r, doc_id, k, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL)),
b AS (SELECT r, doc_id, k, i, list_transform(string_split(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS w FROM a),
l AS (SELECT r, doc_id, k, i, w, array_to_string(w, ' ') AS line, concat(len(w), ' ', array_to_string(w[1:3], ' ')) AS leaf FROM b WHERE len(w) >= 3),
busy AS (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT r) >= 8),
m AS (SELECT l.* FROM l JOIN busy USING (leaf)),
u AS (SELECT leaf, line, any_value(w) AS w, count(DISTINCT (doc_id, k)) AS docs FROM m GROUP BY leaf, line),
p AS (SELECT leaf, line, docs, p, w[p] AS token FROM (SELECT leaf, line, docs, w, unnest(range(1, len(w) + 1)) AS p FROM u)),
c AS (SELECT leaf, p, token, sum(docs) >= 8 AS often FROM p GROUP BY leaf, p, token),
g AS (SELECT leaf, line, list(CASE WHEN (often OR p <= 3) AND token <> '<*>' THEN token ELSE '<*>' END ORDER BY p) AS general, count(*) FILTER ((often OR p <= 3) AND token <> '<*>') AS constants, count(*) AS n FROM p JOIN c USING (leaf, p, token) GROUP BY leaf, line),
t AS (SELECT leaf, line, CASE WHEN constants * 100 >= n * 70 THEN array_to_string(general, ' ') ELSE line END AS template FROM g),
s AS (SELECT leaf, template, min((doc_id, k)) AS first FROM m JOIN t USING (leaf, line) GROUP BY leaf, template HAVING count(DISTINCT (doc_id, k)) >= 8),
gone AS (SELECT DISTINCT r, i FROM m JOIN t USING (leaf, line) JOIN s USING (leaf, template) WHERE (doc_id, k) <> first),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM a ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
x AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, coalesce(n.n, 0) AS n_lines, coalesce(x.n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r) LEFT JOIN kept USING (r)
"""
