"""Quality rules, in DataFrame functions only: base counts, and a hashed n-gram log-likelihood ratio between two multinomials.

The ratio compares a multinomial over hashed word unigrams and bigrams of the trusted documents with one of the whole
corpus. A document's score is the mean over its n-grams of log p_trusted - log p_corpus; it is kept if the score
reaches a threshold that is the same for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import MOST_IDS, ids_side, stage

#: Java's pattern for the white space between words.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"


def _rest(array: Column, skip: int) -> Column:
    return F.slice(array, skip + 1, F.greatest(F.size(array) - skip, F.lit(0)))


def _front(array: Column, drop: int) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - drop, F.lit(0)))


def _hashed_words(rows: DataFrame) -> DataFrame:
    """Adds word_hashes, pair_hashes: 64-bit hashes of the words and of neighbouring words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    rows = rows.withColumn("word_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    return rows.withColumn("pair_hashes", F.zip_with(_front(F.col("word_hashes"), 1), _rest(F.col("word_hashes"), 1), lambda a, b: F.xxhash64(a, b)))


def _buckets(n: int) -> Column:
    return F.transform(F.concat("word_hashes", "pair_hashes"), lambda h: F.pmod(h, F.lit(n)).cast("int"))


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that the text has twice or more (by the windows' 64-bit hash)."""
    threes = F.zip_with(_front(F.col("pair_hashes"), 1), _rest(F.col("word_hashes"), 2), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("threes", threes)
    repeats = F.size(F.array_distinct("threes")) < F.size("threes")
    placed = F.sort_array(F.transform("threes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("placed", F.when(repeats, placed))
    twice = F.zip_with(_front(F.col("placed"), 1), _rest(F.col("placed"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    covered = F.aggregate(F.zip_with(_front(F.col("at"), 1), _rest(F.col("at"), 1), lambda a, b: F.least(b - a, F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("at") > 0, covered + 3).otherwise(F.lit(0)).cast("long")).drop("threes", "placed", "at")


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to rows with `text` and hashed words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = _repeat_words(rows.withColumn("lines", lines))
    n = F.size("word_hashes").cast("long")
    return rows.select(
        "*",
        n.alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
    ).drop("lines")


def bucket_weights(rows: DataFrame, buckets: int, smooth: float) -> DataFrame:
    """One row, one array of `buckets` doubles: log p_trusted - log p_corpus for each bucket; all 0 without trusted text.

    Every n-gram of every row is counted; partial sums leave each task as `buckets` rows at most.
    """
    spark = rows.sparkSession
    seen = rows.select("trusted", F.explode(_buckets(buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.when(F.col("trusted"), 1)).alias("t"), F.count("*").alias("r"))
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left").na.fill(0, ["t", "r"])
    counts = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    odds = lambda x: F.log((x["t"] + smooth) / (F.col("nt") + smooth * buckets)) - F.log((x["r"] + smooth) / (F.col("nr") + smooth * buckets))
    return counts.select(F.transform("c", lambda x: F.when(F.col("nt") > 0, odds(x)).otherwise(0.0)).alias("weights"))


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = 10_000, smooth: float = 1.0, quantile: float = 0.001, slack: float = 0.03, broadcast_ids: int = MOST_IDS, keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text and, as asked by `keep`, further columns), without its text.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score double (null
    without words), threshold double, kept. `trusted` has the doc_ids of trusted text; its ids are joined by broadcast
    if there are no more than `broadcast_ids` of them (32 MB), else by a shuffle. The threshold is the `quantile` of
    the trusted documents' scores (rounded to 0.001, so exact with bounded memory) less `slack`; without trusted text
    nothing is rejected by score. Null and empty texts have no words and fail the base rules; repeated rows are judged
    each; equal scores fare alike.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "text")]
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    rows = docs.select("doc_id", *keep, "text").join(ids_side(ids, broadcast_ids), F.col("doc_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")
    hashed = _hashed_words(rows)
    weights = bucket_weights(hashed, buckets, smooth)
    total = F.aggregate(_buckets(buckets), F.lit(0.0), lambda s, b: s + F.element_at(F.col("weights"), b + 1))
    scored = base_counts(hashed).withColumn("weights", stage(weights, "weights").scalar())
    n_grams = F.size("word_hashes") + F.size("pair_hashes")
    scored = scored.withColumn("score", F.when(n_grams > 0, total / n_grams)).drop("weights", "word_hashes", "pair_hashes", *([] if keep_text else ["text"]))
    scored = stage(scored, "scores")  # the threshold and the verdicts both read them
    cut = scored.where("trusted and not base_failed").agg((F.percentile(F.round("score", 3), F.lit(quantile)) - slack).alias("threshold"))
    verdict = ~F.col("base_failed") & (F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")))
    return scored.withColumn("threshold", cut.scalar()).withColumn("kept", verdict).drop("trusted")
