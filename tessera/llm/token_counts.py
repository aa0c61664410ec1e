"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frequency_join import index_blocks, shard_words, sum_by_document, value_words
from .presplit import PreSplitter
from .workspace import partitions, ship, stage, unstage


def piece_counter(spec: bytes) -> Callable[[list[str]], list[int]]:
    """Counts the pieces of pre-tokens with the library's model; a special token's string is one piece."""
    import json

    from tokenizers import Tokenizer

    made = json.loads(spec)
    made["normalizer"] = None  # pre-tokens are normalized and split already
    made["pre_tokenizer"] = made["pre_tokenizer"]["pretokenizers"][-1]
    library = Tokenizer.from_str(json.dumps(made))
    return lambda words: [len(e) for e in library.encode_batch_fast(words, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens; repeated rows are counted each; other columns are not read. Ids of
    tokens are never made for documents: only distinct pre-tokens meet the tokenizer, and counts come back by a join.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one tokenizer file, about 2 MB
    shards = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("boolean").alias("mark"), F.col(text_col).alias("text"))
    blocks = stage(index_blocks(rows, lambda: PreSplitter(spec.value).split, shards), "pretokens")
    values = value_words(shard_words(blocks, shards), lambda: piece_counter(spec.value), "<u4")
    counts = stage(sum_by_document(blocks, values, "<u4", "n_tokens").select("doc_id", F.col("size").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")
    unstage(blocks)
    return counts
