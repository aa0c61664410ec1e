"""Per-document word frequencies in blocks, and the join that brings each distinct word's value back to them.

A block is a run of documents of one partition. Its postings (which words each document has, and how often) are one
compressed value; its distinct words are packed by hash shard. Only the packed words are shuffled to be valued, once
for each distinct word of a shard, so a word in every document is one entry for each block and never a hot key.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import small_batches

#: Characters after which a block is closed (a single longer text is a block by itself).
BLOCK_CHARS = 12_000_000


def pack(values, kind: str) -> bytes:
    """Integers as byte planes under zstd."""
    import numpy as np

    flat = np.ascontiguousarray(values, dtype=kind)
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T) if flat.size else flat
    return flat.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if flat.size else (0).to_bytes(8, "little")


def unpack(data: bytes, kind: str):
    import numpy as np

    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind).copy()


def pack_words(words: list[str]) -> bytes:
    raw = "\n".join(words).encode("utf-8", "surrogatepass")
    return len(words).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_words(data: bytes) -> list[str]:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    return pa.decompress(data[16:], size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") if n else []


BLOCKS = "block long, docs array<struct<doc_id:long,lang:string,mark:boolean,size:long>>, n_words binary, word_ids binary, counts binary, shards array<struct<shard:int,words:binary>>"


def utf8_size(text: str | None, words: list[str]) -> int:
    return len(text.encode("utf-8", "surrogatepass")) if text else 0


def index_blocks(docs: DataFrame, splitter: Callable[[], Callable[[str | None], list[str]]], shards: int, sizer: Callable[[str | None, list[str]], int] = utf8_size) -> DataFrame:
    """BLOCKS of documents (doc_id, lang, mark, text). `splitter()` makes, once for each task, the function from text to words.

    Word numbers of a block run over its words sorted by (shard, word). Words hold no line break.
    """
    rows = docs.select("doc_id", "lang", "mark", "text")
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("mark", pa.bool_()), ("size", pa.int64())]))), ("n_words", pa.binary()), ("word_ids", pa.binary()), ("counts", pa.binary()), ("shards", pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        split, part, made = splitter(), TaskContext.get().partitionId(), count()

        def closed(heads: list[tuple], lists: list, vocab: dict[str, int]) -> pa.RecordBatch:
            keyed = sorted((shard_of(w, shards), w) for w in vocab)
            words = [w for _, w in keyed]
            rank = np.empty(len(words), np.int64)
            rank[np.fromiter(map(vocab.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
            lengths = np.array([len(x) for x in lists], np.int64)
            flat = rank[np.concatenate(lists)] if len(words) else np.zeros(0, np.int64)
            pairs, counts = np.unique((np.repeat(np.arange(len(lists)), lengths) << 32) | flat, return_counts=True)
            of, ids = pairs >> 32, pairs & 0xFFFFFFFF
            steps = np.diff(ids, prepend=0)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            steps[first] = ids[first]
            packed, at = [], 0
            kinds = np.array([s for s, _ in keyed], np.int64)
            for s in np.unique(kinds):
                n = int(np.count_nonzero(kinds == s))
                packed.append({"shard": int(s), "words": pack_words(words[at : at + n])})
                at += n
            row = {"block": (part << 33) + next(made), "docs": [dict(zip(("doc_id", "lang", "mark", "size"), h, strict=True)) for h in heads], "n_words": pack(np.bincount(of, minlength=len(lists)), "<u4"), "word_ids": pack(steps, "<u4"), "counts": pack(counts, "<u4"), "shards": packed}
            return pa.RecordBatch.from_pylist([row], schema)

        heads, lists, chars = [], [], 0
        vocab: dict[str, int] = defaultdict(count().__next__)
        for batch in small_batches(batches):
            for doc_id, lang, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split(text)
                heads.append((doc_id, lang, mark, sizer(text, words)))
                lists.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
                chars += len(text or "") + 200
                if chars >= BLOCK_CHARS:
                    yield closed(heads, lists, vocab)
                    heads, lists, chars = [], [], 0
                    vocab = defaultdict(count().__next__)
        if heads:
            yield closed(heads, lists, vocab)

    return rows.mapInArrow(run, BLOCKS)


def shard_of(word: str, shards: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % shards


def shard_words(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, words): the packed words, dealt by shard."""
    return blocks.select("block", F.explode("shards").alias("s")).select("block", F.col("s.shard").alias("shard"), F.col("s.words").alias("words")).repartition(shards, "shard")


def value_words(words: DataFrame, valuer: Callable[[], Callable[[list[str]], list]], kind: str) -> DataFrame:
    """(block, shard, vals): each distinct word of a partition is valued once; `vals` follows the order of `words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, known = valuer(), {}
        for batch in batches:
            out = []
            for packed in batch.column(2).to_pylist():
                words = unpack_words(packed)
                new = [w for w in words if w not in known]
                known.update(zip(new, value(new), strict=True))
                out.append(pack([known[w] for w in words], kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "shard", "vals"])

    return words.mapInArrow(run, "block long, shard int, vals binary")


def postings(row: dict):
    """(distinct words of each document, document, word number, frequency) of a block."""
    import numpy as np

    n, steps, counts = (unpack(row[k], "<u4").astype(np.int64) for k in ("n_words", "word_ids", "counts"))
    before = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    sums = np.concatenate([[0], np.cumsum(steps)])
    return n, of, sums[1:] - sums[before][of], counts


def sum_by_document(blocks: DataFrame, values: DataFrame, kind: str, out: str, as_type: str = "long") -> DataFrame:
    """(doc_id, lang, mark, size, n_words, <out>): for each document, the sum over its words of frequency times value."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        got = {s: v for s, v in zip(right.column("shard").to_pylist(), right.column("vals").to_pylist(), strict=True)}
        vals = np.concatenate([unpack(got[s], kind) for s in sorted(got)]) if got else np.zeros(0, kind)
        vals = vals.astype(np.float64 if as_type == "double" else np.int64)
        heads, sums, totals = [], [], []
        for row in left.select(["docs", "n_words", "word_ids", "counts"]).to_pylist():
            n, of, ids, counts = postings(row)
            ends = np.cumsum(n)
            if as_type == "double":
                sums.append(np.bincount(of, weights=vals[ids] * counts, minlength=len(n)))
            else:
                total = np.concatenate([[0], np.cumsum(vals[ids] * counts)])
                sums.append(total[ends] - total[ends - n])
            totals.append(np.bincount(of, weights=counts, minlength=len(n)).astype(np.int64))
            heads += row["docs"]
        return pa.table({"doc_id": pa.array([h["doc_id"] for h in heads], pa.int64()), "lang": pa.array([h["lang"] for h in heads], pa.string()), "mark": pa.array([h["mark"] for h in heads], pa.bool_()), "size": pa.array([h["size"] for h in heads], pa.int64()), "n_words": pa.array(np.concatenate(totals) if totals else [], pa.int64()), out: pa.array(np.concatenate(sums) if sums else [], pa.float64() if as_type == "double" else pa.int64())})

    left = blocks.select("block", "docs", "n_words", "word_ids", "counts").groupBy("block")
    return left.cogroup(values.groupBy("block")).applyInArrow(run, f"doc_id long, lang string, mark boolean, size long, n_words long, {out} {as_type}")
