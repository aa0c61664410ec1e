"""Resampling of documents by importance towards a target distribution, on hashed n-gram features.

Features are word n-grams, hashed by CRC-32 to a fixed number of buckets. Each word's CRC is made once for each worker,
and the CRCs of n-grams are composed from those of their words (crc_algebra): no n-gram string is ever made. Bucket
counts of the corpus and of the target give each bucket a gain, a document's weight is the mean gain of its features, and
a draw without replacement takes the documents with the highest weight plus Gumbel noise hashed from their ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crc_algebra
from .workspace import partitions, ship, small_batches, stage, unstage

__all__ = ["bucket_counts", "gains", "importance_sample", "ranked"]

#: Letters a to z, digits and all bytes of other characters stay, A to Z are lowered, the rest parts words. A fixed value.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Words whose CRCs a task keeps; beyond it all are forgotten before the next batch.
WORD_LIMIT = 400_000


class _Crcs(dict):
    """CRC of each word, made when first asked for. Words of over 256 bytes are not kept."""

    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        if len(word) <= 256:
            self[word] = crc
        return crc


def _features(texts: pa.Array, crcs: _Crcs, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each feature of a batch of texts, and the number of words by row. Null: none."""
    if len(crcs) > WORD_LIMIT:
        crcs.clear()
    words = [[] if t is None else t.translate(WORD_BYTES).split() for t in texts.cast(pa.binary()).to_pylist()]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n_words.sum())
    flat = [w for row in words for w in row]
    crc = np.fromiter(map(crcs.__getitem__, flat), np.uint32, total)
    row = np.repeat(np.arange(len(words)), n_words)
    if most > 1:
        row, crc = crc_algebra.runs(crc, np.fromiter(map(len, flat), np.int64, total), row, zlib.crc32(b" "), least, most)
    return row, (crc % np.uint32(buckets)).astype(np.int64), n_words


def bucket_counts(docs: DataFrame, text_col: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket. Each task adds up its own rows; the driver gets one row for each bucket in use."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crcs, counts = _Crcs(), np.zeros(buckets, np.int64)
        for batch in small_batches(batches):
            counts += np.bincount(_features(batch.column(0), crcs, least, most, buckets)[1], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed bucket shares), target over raw, in doubles."""
    n, whole, aim = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (whole + n) / ((float(s) + 1) * (aim + n)))) for s, t in zip(raw, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor of 1000 times a Gumbel number that is hashed from the id; a null id is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """`rows` with their place (1, 2, ...) in `order`, by a range shuffle and counts of its partitions: no task holds all rows. Staged; rows equal in all of `order` are placed in any order."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    at = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    return at.join(offsets, part == F.col("_part")).select(*rows.columns, (F.col("_before") + own + 1).alias(name))


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Features are all runs of `least` to `most` words. A document without features weighs 0. Of the N documents with at
    least `least_words` words, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller id; null ids
    come after all others, and equal rows are drawn in any order. Null and empty texts have no words; an empty `docs`
    gives no rows, an empty `target` gives gains towards rare buckets.

    Texts are read twice and never shuffled; only (id, features, weight, score) is, to be ranked. The driver holds one
    number for each bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, least, most, buckets), bucket_counts(target, target_col, least, most, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crcs, by_bucket = _Crcs(), gain.value
        for batch in small_batches(batches):
            row, bucket, n_words = _features(batch.column(1), crcs, least, most, buckets)
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, by_bucket[bucket])
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(score), pa.array(n_words >= least_words)], ["doc_id", "n_features", "weight", "score", "eligible"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_features long, weight long, score long, eligible boolean"), "importance")
    n_drawn = percent * scored.where("eligible").count() // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    out = ranked(scored, order, "place")
    unstage(scored)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("place") <= n_drawn), F.col("place")).alias("rank"))
