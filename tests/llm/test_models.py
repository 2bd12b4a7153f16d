import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import language_id, quality_classifier, toxicity, url_filters

SMALL = "/root/testdata/sf0.01"


def outside(doc_id, modulus, value):
    return zlib.crc32(str(doc_id).encode()) % modulus == value


def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = language_id.op1_language_id(spark, SMALL).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == outside(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "123 !?", "en", 0.5), (3, "the cat and the dog", "en", 0.5), (4, "der hund und die katze", "de", 0.5), (5, "x", None, 0.5), (5, "漢字 かな " * 2000, None, 0.5)], "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect()]
    assert got[:4] == [(1, "und"), (2, "und"), (3, "en"), (4, "de")] and all(x in ("en", "de") for _, x in got[4:])
    empty = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_trigrams_are_bound_in_order():
    a, b = language_id.Trigrams(["abc"]), language_id.Trigrams(["cba"])
    cosine = a.vector(0) @ b.vector(0) / np.linalg.norm(a.vector(0)) / np.linalg.norm(b.vector(0))
    assert cosine < 0.6 and np.array_equal(language_id.Trigrams(["zz", "ABC"]).vector(1), a.vector(0))


def plain_vector(text):
    """Trigram by trigram, letter by letter."""
    out = np.zeros(language_id.DIM)
    words = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ").split()
    line = " " + "".join(w + " " for w in words) if words else ""
    for i in range(len(line) - 2):
        a, b, c = (language_id.letter_vector(ord(x)).astype(int) for x in line[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_vectors_equal_plain_loops(monkeypatch):
    texts = ["Straße 12 über-all", "x", "漢字 かな", "the cat, the hat; the " * 9, "ÀÉ 1a2b\nç"]
    want = [plain_vector(t) for t in texts]
    for table, block, segment in ((1 << 14, 1 << 12, 1 << 20), (0, 3, 1 << 20), (0, 5, 8)):
        monkeypatch.setattr(language_id, "TABLE", table)
        monkeypatch.setattr(language_id, "BLOCK", block)
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        assert all(np.array_equal(v, w) for v, w in zip(language_id.vectors([*texts, None, "5 !"]), want))
        assert language_id.vectors([None, "5 !"]) == [None, None]


def test_segments_cover_a_text():
    text = "word and word " * 50 + "x" * 100
    got = list(language_id.segments(text, 16))
    assert "".join(got) == text and all(len(x) <= 32 for x in got) and len(got) > 20


def test_memory_of_a_long_text_of_many_letters():
    import tracemalloc

    rng = np.random.default_rng(0)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 200_000)))
    tracemalloc.start()
    v = language_id.vectors([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.linalg.norm(v) > 0 and peak < 200e6


def test_quality_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = quality_classifier.op6_quality_classifier(spark, SMALL).collect()
    assert len(rows) == 1000 and all(r["held_out"] == outside(r["doc_id"], 3, 1) and (r["score"] >= 0.5) == r["predicted"] for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.95


def test_families_of_word_forms(spark):
    words = toxicity.Counter("grobian grobheit grober gut".split())
    assert {f for f in toxicity.forms(words) if f.endswith("**")} == {"grob**"}
    assert "grob**" not in toxicity.forms(toxicity.Counter({"grobian": 5, "gut": 1}))  # one word, however often
    assert "grob**" in toxicity.forms(words + toxicity.Counter(gut=3 * toxicity.APART - 4))
    assert "grob**" not in toxicity.forms(words + toxicity.Counter(gut=3 * toxicity.APART - 3))
    grammar = toxicity.Grammar(frozenset(["grob**"]))
    assert grammar.patterns("der grobian. grobheit!", {}) == {"F": 2}
    assert not grammar.patterns("der grobian. grobian!", {})
    assert toxicity.covering("grobia**") == {"grob*", "grobi*", "grobia*", "grob**", "grobi**"}
    assert toxicity.covering("grobi") == {"grob*", "grobi*"}
    letters = "abcdefghij"
    texts = [" ".join(f"grob{letters[(i + k) % 10]}{'rs'[k]}" for k in range(2 if i < 30 else 1 if i < 60 else 0)) for i in range(300)]
    rows = [(i, f"{t} gut {letters[i % 10]}{letters[i // 10 % 10]}q", int(i < 30)) for i, t in enumerate(texts)]
    train = spark.createDataFrame(rows, "k int, t string, y int")
    learned = toxicity.learn_forms(train)
    assert "grob**" in learned and "grob*" not in learned


def test_toxicity_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = toxicity.op10_toxicity(spark, SMALL).collect()
    assert len(rows) == 1000 and all(r["held_out"] == outside(r["doc_id"], 4, 2) and (r["score"] >= 0.3) == r["predicted"] for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for t, p in held if t]) > 0.6 and np.mean([p for t, p in held if not t]) < 0.02


def test_only_near_copies_count_once(spark):
    long = " ".join(f"word{i} stays" for i in range(40))
    base = [("aardvark " + w, 1) for w in ("one two", "three four", "five six")] + [(long, 1), (long + " too", 1), (long, 1), (long, 0), ("", 0), (" ", 0)]
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(base)], "k long, t string, y int")
    got = [(r["t"], r["y"]) for r in toxicity.without_copies(train).collect()]
    assert len(got) == 7 and len({t for t, y in got if y == 1 and t.startswith("aardvark")}) == 3
    assert sum(t.startswith("word0") and y == 1 for t, y in got) == 1 and (long, 0) in got
    # Texts that only share the word of the smallest hash are learned from one by one
    rows = [(f"aardvark {w} grobian", 1) for w in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op")] + [(f"{a}{b} fine", 0) for a in "abcdefghij" for b in "qrstuvwxyz"]
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "k long, t string, y int")
    assert any("grobian".startswith(f.rstrip("*")) for f in toxicity.learn_forms(train))


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "good words here", 9), (None, "x " * 30_000, 9)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 7)], f"doc_id long, {label} int")
    for some in (labels, labels.limit(0)):
        rows = module.score(docs, module.fit(docs, some)).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0


def test_ftrl_learns_and_drops_noise():
    rng = np.random.default_rng(0)
    model = quality_classifier.FollowTheLeader(50)
    for _ in range(2000):
        y = int(rng.integers(0, 2))
        model.update(np.array([y, int(rng.integers(10, 50)), 49]), np.array([1.0, 0.1, 1.0]), y)
    w = model.weights()
    assert w[1] > 1 and w[0] < -1 and np.abs(w[10:49]).max() < 0.5


@pytest.mark.parametrize(
    "text, pattern",
    [
        ("You are an idiot", "I@"),
        ("idiot, I say to you", "I@"),
        ("What an idiot", "I"),
        ("You are not an idiot", "I-@"),
        ("not now but in a year or two you will be an idiot", "I@"),
        ("He said you are an idiot", "I~@"),
        ("He said you are no idiot", "I-~@"),
        ("I will kill you", "T@"),
        ("We kill time", None),
        ("You are a waste of space", "I@"),
        ("A waste of good space", None),
        ("they read. We kill time", None),
        ("Nothing here", None),
    ],
)
def test_clauses(text, pattern):
    assert dict(toxicity.Grammar().patterns(text, {})) == ({pattern: 1} if pattern else {})


def all_paths(machine, symbols, state=None, out=(), weight=0.0):
    state = machine.start if state is None else state
    if not symbols:
        return [(out, weight)] if state in machine.finals else []
    return [p for o, w, to in machine.arcs.get((state, symbols[0]), ()) for p in all_paths(machine, symbols[1:], to, (*out, o), weight + w)]


def test_composition_equals_path_enumeration():
    rng = np.random.default_rng(4)

    def machine():
        arcs = {}
        for state in range(3):
            for x in "abc":
                arcs[state, x] = tuple((str(rng.choice(list("abc"))), float(rng.integers(-4, 5)), int(rng.integers(0, 3))) for _ in range(rng.integers(0, 3)))
        return toxicity.Transducer(arcs, frozenset(map(int, rng.integers(0, 3, 2))))

    for _ in range(60):
        a, b = machine(), machine()
        both = toxicity.compose(a, b)
        for _ in range(5):
            word = tuple(map(str, rng.choice(list("abc"), rng.integers(0, 6))))
            want = [(o2, w + v) for o, w in all_paths(a, word) for o2, v in all_paths(b, o)]
            assert sorted(all_paths(both, word)) == sorted(want)
            assert both.best(word) == max((w for _, w in want), default=None)


def test_clause_is_the_best_of_all_paths():
    rng = np.random.default_rng(8)
    words = "you idiot not said kill waste of space and the trash piece".split()
    grammar = toxicity.Grammar()

    def readings(text, state=0, out=()):
        if not text:
            return [out] if state == 0 else []
        return [r for x, to in grammar.lexical(state, text[0], {}) for r in readings(text[1:], to, (*out, x))]

    for _ in range(120):
        text = list(map(str, rng.choice(words, rng.integers(1, 9))))
        want = max((w for r in readings(text) for _, w in all_paths(toxicity.MACHINE, r)), default=0.0)
        assert grammar.clause(text, {})[0] == pytest.approx(want)


def test_scores_follow_the_grammar():
    m = toxicity.Model()
    s = {t: m.score(m.grammar.patterns(t, {})) for t in ("You idiot", "You are no idiot", "She said: someone wrote idiot", "fine")}
    assert s["You idiot"] > 0.3 > s["You are no idiot"] > s["fine"]


def test_url_rules():
    rules = url_filters.Rules(url_filters.RULES)
    want = {("a.com", "/en/1"): ("com/en/", "block"), ("x.example.com", "/en/7"): ("example.com/en/7", "allow"), ("example.com", "/fr/"): None, ("notcom", "/en/"): None, ("b.example.net", "/de/81"): ("example.net/de/8", "block"), ("c.net", "/de/81"): ("net/de/", "allow"), ("", ""): None}
    assert {k: rules.find(*k) for k in want} == want


@pytest.mark.parametrize("url, parts", [("HTTP://A.B/c?d#e", ("a.b", "/c")), ("x://h?y/z", ("h", "")), ("no", ("", "")), (None, ("", "")), ("a://É.X#p", ("É.x", "")), ("a\n://h\n/p", ("h\n", "/p"))])
def test_url_parts(url, parts):
    assert url_filters.split_url(url) == parts


def test_url_verdicts(spark):
    names = ["https://casinowin.example.org/a", "http://cheap-pills.example.org/", "http://www.goodbooks.example.org/fr/2", "http://quietname.example.org/", None, "none"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(names * 2)], "page_id long, url string, host string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages).collect()}
    assert [got[i] for i in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"] and len(got) == 12
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_hosts_do_not_vouch_for_their_own_labels(spark):
    names = [f"http://{sub}{label}.example.org/fr/{label}" for label in ("freecasino", "quietname", "goodbooks") for sub in ("", "www.", "m.", "blog.")]
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages).collect()}
    assert [got[i] for i in range(12)] == ["block"] * 4 + ["allow"] * 8


def test_many_words_do_not_make_a_label_known(spark):
    letters = F.translate(F.hex(F.col("page_id") * 20 + F.lit(1 << 24) + F.col("x")), "0123456789ABCDEF", "abcdefghijklmnop")
    many = spark.range(2_000).withColumnRenamed("id", "page_id").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19)))).groupBy("page_id").agg(F.array_join(F.collect_list(letters), "/").alias("w"))
    names = [f"http://{sub}{label}.example.org/fr/" for label in ("freecasino", "quietname") for sub in ("", "www.", "m.", "blog.")]
    pages = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(names)], "page_id long, url string")
    kinds = url_filters.read_urls(pages.union(many.select("page_id", F.concat(F.lit("http://h"), "page_id", F.lit(".example.org/fr/"), "w"))), url_filters.RULES)
    got = {r["host"]: r["names"] for r in url_filters.split_names(kinds)[0].collect()}
    assert got["www.freecasino.example.org"][1:3] == ["free", "casino"] and got["m.quietname.example.org"][1] == "quietname"
    pages = pages.union(many.limit(500).select("page_id", F.concat(F.lit("http://h"), "page_id", F.lit(".example.org/fr/"), "w")))
    assert sum(r["verdict"] == "block" for r in url_filters.judge(pages).collect()) == 4


def test_url_query_covers_all_pages(spark):
    """Hosts, paths and rules as SQL finds them, and an own plain choice of the rule."""
    import duckdb

    rows = {r["page_id"]: r for r in url_filters.op5_url_filters(spark, SMALL).collect()}
    want = duckdb.sql(rf"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM '{SMALL}/pages.parquet'),
        r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
        SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
        FROM u LEFT JOIN r ON ((host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) GROUP BY ALL""").fetchall()
    assert len(rows) == len(want) == 250
    for page, host, path, rule, verdict in want:
        r = rows[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
        assert (r["score"] is None) == (rule is not None)
        assert rule is not None or r["verdict"] == ("block" if r["score"] > 0 else "allow")


def test_rules_teach_words_that_no_list_has(spark):
    """Hosts whose concatenated words the rules' verdicts have taught, on hosts, and under paths, that no rule judges."""
    bad, good = ["zorbix", "quandle", "vimmo", "kraspel"], ["lindum", "paverno", "siltra", "ombeka"]
    urls = [f"http://plain{k}.example.net/fr/{w}" for k in range(4) for w in bad + good]  # what makes them words
    urls += [f"http://{a}{b}.shop{i}.com/en/{i}" for i, (a, b) in enumerate((a, b) for a in bad[:3] for b in bad[:3])]
    urls += [f"http://{a}{b}.shop{i}.net/de/{i}" for i, (a, b) in enumerate((a, b) for a in good[:3] for b in good[:3])]
    new = [(f"http://{bad[0]}{bad[2]}.new.org/fr/1", "block"), (f"http://x.org/fr/{bad[1]}{bad[0]}{bad[1]}", "block"), (f"http://{good[1]}{good[2]}.new.org/fr/1", "allow"), ("http://neverseen.org/fr/1", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls + [u for u, _ in new])), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages).collect()}
    assert [got[len(urls) + i] for i in range(len(new))] == [v for _, v in new]
    assert all(set(url_filters.words_of(u)).isdisjoint(url_filters.STRONG | url_filters.WEAK) for u, v in new if v == "block" and ".org/fr/1" in u)


def test_odds_equal_plain_counts():
    """Two buckets of examples, by hand."""
    counts = np.zeros((2, url_filters.SIZE))
    one, two = url_filters._bucket("wordone"), url_filters._bucket("wordtwo")
    counts[0, one], counts[0, two], counts[1, two] = 30, 10, 4
    odds = url_filters.token_odds(counts)
    seeds = {y: sum(n * len(w) for w, k, n in url_filters.SEEDS if k == y) for y in (0, 1)}
    size = len({url_filters._bucket(w) for w in url_filters.LISTS} | {one, two})
    p = lambda n, y: np.log((n + url_filters.ALPHA) / (4 + seeds[y] + url_filters.ALPHA * size))
    assert odds[one] == pytest.approx(p(0, 1) - p(3, 0)) and odds[two] == pytest.approx(p(4, 1) - p(1, 0))


def test_long_and_odd_urls(spark):
    urls = ["http://" + "casino" * 3000 + ".org/fr/" + "x" * 50_000, "http://пример.рф/путь/" + "казино" * 10, "http://1.2.3.4/a1b2/99", "http://a.org/" + "w/" * 20_000]
    rows = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert rows[0]["verdict"] == "block" and {rows[i]["verdict"] for i in (1, 2, 3)} == {"allow"}
    assert url_filters.words_of("/a1b2/99") == ["a1b2", "0"] and rows[1]["host"] == "пример.рф"


def test_segmentation():
    words = url_filters.Words(np.zeros((url_filters.ROWS, url_filters.WIDTH)), 10_000.0)
    assert words.segment("casinowin") == ("casino", "win") and words.segment("bookshop") == ("book", "shop")
    assert words.segment("betterhouse") == ("betterhouse",) and words.segment("") == ()
