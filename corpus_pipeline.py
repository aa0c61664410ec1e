"""The corpus pipeline: toxicity, quality rules, near duplicates, mixing of sources, and BPE encoding, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_automaton import encode_decode
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import tokenizer_path, trusted_ids
from tessera.llm.toxicity import toxicity
from tessera.llm.workspace import held_out, ids_side, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity(docs, labels, cut=0.3, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    judged = quality_rules(docs, trusted_ids(table(spark, sf_dir, "labels")), keep=COLUMNS, keep_text=True)
    return judged.where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays. Rows of a null or repeated id are documents of their own, met by numbers past all ids."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    if ids.isEmpty():
        rows = docs.select(*COLUMNS, F.col("doc_id").alias("row_id"))
    else:
        high = docs.agg(F.max("doc_id")).first()[0] or 0
        again = ids_side(stage(ids.where("doc_id is not null"), "repeated").withColumn("again", F.lit(True)))
        number = F.when(F.col("again") | F.col("doc_id").isNull(), F.monotonically_increasing_id() + high + 1).otherwise(F.col("doc_id"))
        rows = stage(docs.select(*COLUMNS).join(again, "doc_id", "left").select(*COLUMNS, number.alias("row_id")), "numbered")
    gone = stage(near_duplicates(rows.select(F.col("row_id").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("row_id")).distinct(), "dropped")
    return rows.join(ids_side(gone), "row_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources weigh the square root of their size, in a global random order."""
    return mix(docs, temperature=0.5).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the decoded text."""
    return encode_decode(docs, tokenizer_path(), ids=True, keep=["lang", "source"])


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("minhash_near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Hashed features, trained weights and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents`, each staged in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
