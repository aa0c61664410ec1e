"""BPE and token counts against the tokenizer's own library."""

import hashlib
import pickle
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe_automaton import Compiled, MergeAutomaton, WordCodec, encode_decode
from tessera.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return WordCodec(pickle.loads(pickle.dumps(Compiled(f.read()))))


def test_automaton_gadget_by_hand():
    vocab = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aa", "aab", "b" + "b</w>"])}
    made = MergeAutomaton(vocab, [("a", "b"), ("a", "a"), ("aa", "b"), ("b", "b</w>")])
    names = {i: t for t, i in vocab.items()}
    assert [names[i] for i in made.encode(b"aab")] == ["aa", "b</w>"]  # the rule a b is of a "b" inside a word
    assert [names[i] for i in made.encode(b"abab")] == ["ab", "a", "b</w>"]
    assert not made.step(vocab["a"], vocab["b"])
    assert made.step(vocab["aa"], vocab["a"]) and not made.step(vocab["a"], vocab["aa"])


def test_random_strings_like_the_library(codec, library):
    random.seed(5)
    letters = "abcdefghijklmnopqrstuvwxyz'''    !?.,0123456789éüñßÀΣσς½²\n\t\x1c\x85_中文한🎉İ"
    for k in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40))) + "<|endoftext|>" * (k % 11 == 0)
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words(codec, library):
    for text in ("a" * 3000, "ab" * 2000, "!" * 500, "é" * 700, "antidisestablishmentarianism" * 4000):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = encode_decode(odd_docs, PATH, ids=True, decoded=True, keep=["source"]).collect()
    texts = {(r["doc_id"], r["source"]): r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = library.encode(texts[(r["doc_id"], r["source"])] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert encode_decode(no_docs, PATH).count() == 0


def test_token_counts(spark, odd_docs, no_docs, library):
    rows = token_counts(odd_docs, PATH, limit=100).collect()
    assert len(rows) == odd_docs.count()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 100) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert token_counts(no_docs, PATH).count() == 0


def test_counts_on_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PATH).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in encode_decode(docs, PATH).collect()} == want


def test_token_counts_leave_only_their_result(spark, odd_docs):
    import os

    from tessera.llm.workspace import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/tessera"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert token_counts(odd_docs, PATH).count() == odd_docs.count()
    assert {d.rsplit("-", 1)[0] for d in set(os.listdir(folder)) - before} == {"token-counts"}
