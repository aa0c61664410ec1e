"""Token-id files: the coder's round trips, the encoder against the library, files against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import id_files
from tessera.llm.id_files import IdEncoder, document_digests, encode_texts, read_ids, round_trip, write_ids, write_texts
from tessera.llm.range_coder import BadBlock, BlockCoder
from tessera.llm.workspace import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_rows(docs, library):
    """What the files must give back, by plain Python: nulls first, then by id."""
    rows = [(r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs.collect()]
    return sorted((i is not None, i or 0, len(b) // 4, zlib.crc32(b)) for i, b in rows)


def check(rows, want):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert got == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):  # starts run on without gaps, in the order of ids
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("size", [2, 256, 50257, 1 << 22])
def test_coder_round_trips(size):
    rng = np.random.default_rng(size)
    lengths = [0, 1, 2, 31, 32, 33, 63, 64, 65, 700, 2048, 2049, 5000]
    blocks = [rng.integers(0, size, n) if k % 3 else np.minimum(rng.zipf(1.3, n) - 1, size - 1) for k, n in enumerate(lengths)]
    blocks += [np.zeros(3000, int), np.full(3000, size - 1), np.tile([0, size - 1, 1 % size], 900), np.arange(3000) % size]
    coder = BlockCoder(size, lanes=6)
    coded = coder.encode(blocks)
    for want, got in zip(blocks, coder.decode(coded), strict=True):
        assert np.array_equal(want, got)
    assert coder.encode([blocks[9]]) == [coded[9]]  # a block's bytes do not depend on the blocks beside it
    assert len(coded[14]) < 200  # repetition is nearly free
    assert coder.decode([]) == [] and coder.encode([]) == []


def test_orders_pay():
    """Ids that follow from the two before them cost less than order 0 alone would."""
    rng = np.random.default_rng(3)
    after = rng.integers(0, 1000, (40, 40))
    ids = [1, 2]
    for _ in range(4000):
        ids.append(int(after[ids[-2] % 40, ids[-1] % 40]) if rng.random() < 0.9 else int(rng.integers(0, 1000)))
    (coded,) = BlockCoder(50257).encode([np.array(ids)])
    _, n = np.unique(ids, return_counts=True)
    order0 = -(n * np.log2(n / len(ids))).sum() / 8
    assert len(coded) < 0.9 * order0


def test_bad_blocks():
    coder = BlockCoder(50257)
    (good,) = coder.encode([np.arange(500) % 70])
    for at in (0, 5, 9, 13, 17, 25, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(BadBlock):
            coder.decode([bytes(bad)])
    for cut in (3, 20, len(good) - 7):
        with pytest.raises(BadBlock):
            coder.decode([good[:cut]])
    with pytest.raises(BadBlock):
        BlockCoder(1000).decode([good])


def test_encoder_like_the_library(library, monkeypatch):
    monkeypatch.setattr(id_files, "MOST_PIECES", 200)  # forgetting changes nothing
    with open(PATH, "rb") as f:
        coder = IdEncoder(f.read())
    random.seed(11)
    letters = "aabcdeefst'''     !?.,0123456789éüñßÀσ½²\n\n\t\r\x1c\x85\xa0_中🎉-“”€ ªº"
    for k in range(6000):
        text = "".join(random.choice(letters[: 20 if k % 2 else None]) for _ in range(random.randint(0, 30))) + " <|endoftext|>" * (k % 13 == 0)
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text)
    for text in (" ", "  ", "\n ", " \n", "a  ", "it's  we'll'S ", "x\n \ny", "a" * 5000, "don't " * 3000):
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_encoder_makes_each_piece_once(library):
    """All texts of a batch are cut at once, and a piece's ids are made once, whatever stands beside it."""
    with open(PATH, "rb") as f:
        coder = IdEncoder(f.read())
    asked = []
    own, coder._made = coder._made, lambda pieces: asked.extend(pieces) or own(pieces)
    texts = ["the quick fox", "the quick, fox.", None, "", "l", "'l the \n quick's fox", "it'", "s it's 'sit", "émigré×2 – 5€ the ", "l" * 30 + " " + "l" * 30, "quick中 fox", "\n", "a <|endoftext|> the"]
    for _ in range(2):
        got = coder.encode_all(pa.array(texts), 0).to_pylist()
        assert got == [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u2").tobytes() for t in texts]
    short = [p for p in asked if len(p) <= id_files.LONGEST_KEPT]
    assert len(short) == len(set(short)) and b" quick" in short and b" the" in short
    assert coder.encode_all(pa.array(texts).slice(3, 4)).to_pylist() == [g[:-2] for g in got[3:7]]
    assert coder.encode_all(pa.array([], pa.string()), 0).to_pylist() == []


def test_odd_rows(spark, odd_docs, no_docs, library):
    check(round_trip(odd_docs, PATH, block=64, files=3).collect(), plain_rows(odd_docs, library))
    assert round_trip(no_docs, PATH).count() == 0
    assert round_trip(odd_docs, PATH).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_ids_come_back(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    path = f"{shared_dir(spark)}/ids-come-back"
    write_ids(encode_texts(docs, PATH, end_id=0), path, 50257, block=512, files=2)
    found: dict[int, list] = {}
    for r in read_ids(spark, path, 50257).collect():
        found.setdefault(r["doc_id"], []).append((r["at"], r["start"], r["ids"]))
    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert {i: [t for _, _, ids in sorted(p) for t in ids] for i, p in found.items()} == want
    at = 0
    for i in sorted(want):
        assert {s for _, s, _ in found[i]} == {at}
        at += len(want[i])


def test_texts_are_written_in_one_pass(spark, sf_dir):
    """Files of texts, encoded and coded in one pass, are those of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    one, two = f"{shared_dir(spark)}/from-texts", f"{shared_dir(spark)}/from-ids"
    write_texts(docs, PATH, one, block=256, files=3)
    write_ids(encode_texts(docs, PATH, end_id=0), two, 50257, block=256, files=3)
    by_place = [sorted((r["file"], r["block"], r["n_ids"], bytes(r["data"])) for r in spark.read.parquet(p).collect()) for p in (one, two)]
    assert by_place[0] == by_place[1] and len(by_place[0]) > 3


def test_coder_of_many_lanes():
    """Blocks of more lanes than the coder looks up at a time, some of which end early."""
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.2, n) % 50257 for n in [*range(0, 160, 4), *[300] * 20]]
    coder = BlockCoder(50257)
    coded = coder.encode(blocks)
    assert all(np.array_equal(b, g) for b, g in zip(blocks, coder.decode(coded), strict=True))
    assert coded[::7] == [b for k in range(0, 60, 7) for b in BlockCoder(50257, lanes=1).encode([blocks[k]])]


def test_a_lost_block_is_told(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    path = f"{shared_dir(spark)}/whole-files"
    write_ids(encode_texts(docs, PATH, end_id=0), path, 50257, block=128, files=1)
    short = f"{shared_dir(spark)}/short-files"
    spark.read.parquet(path).where("block <> 1").write.parquet(short)
    with pytest.raises(Exception, match="lacks blocks"):
        document_digests(spark, short, 50257).collect()


def test_whole_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(round_trip(docs, PATH).collect(), plain_rows(docs, library))
