import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


TEXTS = st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(["the ", " 's", "  ", "\n\n", "<|endoftext|>", "<|endof", "'re", "  ", "½²", "aaaa", "ing"])), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_same_as_the_library(library, text):
    ids = bpe.coder(PATH).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.coder(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 5000, "ab" * 3000, "é" * 3000, "x\x00y", "".join(map(chr, range(32, 400)))])
def test_long_and_odd(library, text):
    assert bpe.coder(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_forced():
    c = bpe.coder(PATH)
    word = "zqxjčќ漢".encode()
    parts = c.fragments(word)
    assert b"".join(parts) == word and len(parts) > 1
    assert all((a[-1], b[0]) in c.outside for a, b in zip(parts, parts[1:]))


def test_ids_that_are_no_text():
    c = bpe.coder(PATH)
    assert c.decode(c.encode("é")[:1] if len(c.encode("é")) > 1 else [c.single[0xC3]]) == "\ufffd"


def test_query_on_documents(spark, folder, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in bpe.op4_bpe(spark, folder).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 1), (2, "x y", 2), (2, "x y", 3)], "doc_id long, text string, ids int")
    rows = bpe.round_trip(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2, 2]
    encoded = bpe.encode(docs)
    assert sorted(r["text"] for r in bpe.decode(encoded).collect()) == ["", "", "x y", "x y"]
    assert bpe.round_trip(docs.limit(0)).count() == 0
