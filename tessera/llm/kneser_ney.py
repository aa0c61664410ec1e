"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the trusted documents' text.

The model is of characters running across word boundaries (orders 1 to 5, a space between words, a text's start and end
being symbols), so word order and repetition count. Counts, contexts and probabilities are tables keyed by the n-gram,
made by count joins that are sharded by key. A model that is counted to be small goes to the documents, whose texts are
then read where they lie; beyond that bound the distinct n-grams of blocks of documents go to the model's tables in
joins that are sharded by n-gram, and their values come back. Both give the same perplexities.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequency_join import BLOCK_CHARS, pack, pack_words, shard_of, shard_words, unpack, unpack_words
from .workspace import ids_side, partitions, ship, small_batches, stage, unstage

#: Order of the model across word boundaries.
SEQUENCE_ORDER = 5
#: Symbols before and after a text; words are runs of other characters than white space, so that they cannot hold these.
START, STOP = "\t", "\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of a model's tables, and characters it knows, up to which it goes to the documents: 16 bytes a row, and half-empty tables of twice that in a worker.
MOST_ROWS, MOST_SYMBOLS = 2_000_000, 4_000


def _discounts(grams: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams with counts 1 to 4; usual values where these are too few."""
    row = grams.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [0, row["n1"], row["n2"], row["n3"], row["n4"]]
    usual, out = [0.5, 1.0, 1.5], []
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y else -1.0
        out.append(d if 0 < d <= k else usual[k - 1])
    return out


def model_tables(counts: DataFrame, order: int = SEQUENCE_ORDER) -> tuple[list[DataFrame], list[DataFrame], float]:
    """(probabilities, contexts, floor): for each order (gram, p) and (context, back-off weight); p of an unseen character.

    Lower orders count the different symbols before an n-gram, not its occurrences.
    """
    levels = [counts]
    for n in range(order - 1, 0, -1):
        levels.append(stage(levels[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), "kn-counts"))
    levels = levels[::-1]  # order 1 first
    probs, contexts, floor = [], [], 1.0
    for n, grams in enumerate(levels, 1):
        d = _discounts(grams)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, n - 1)
        sums = grams.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("cuts"))
        contexts.append(stage(sums.select("context", "total", (F.col("cuts") / F.col("total")).alias("back")), "kn-contexts"))
        own = grams.select("gram", "c", context.alias("context")).join(contexts[-1], "context")
        if n == 1:
            kinds = grams.count() + 1
            row = contexts[-1].first()
            floor = (row["back"] if row else 1.0) / kinds
            p = own.select("gram", ((F.col("c") - cut) / F.col("total") + floor).alias("p"))
        else:
            lower = probs[-1].select(F.col("gram").alias("tail"), F.col("p").alias("q"))
            p = own.withColumn("tail", F.substring("gram", 2, n - 1)).join(lower, "tail")
            p = p.select("gram", ((F.col("c") - cut) / F.col("total") + F.col("back") * F.col("q")).alias("p"))
        probs.append(stage(p, "kn-probabilities"))
    for grams in levels:
        unstage(grams)
    return probs, contexts, floor


def gram_scores(grams: DataFrame, model: tuple[list[DataFrame], list[DataFrame], float], order: int = SEQUENCE_ORDER) -> DataFrame:
    """(gram, logp) of distinct `order`-grams: count joins from the highest order down, backing off where an n-gram is new."""
    probs, contexts, floor = model
    out = grams
    for n in range(1, order + 1):
        out = out.withColumn("tail", F.substring("gram", order - n + 1, n)).join(probs[n - 1].select(F.col("gram").alias("tail"), F.col("p").alias(f"p{n}")), "tail", "left").drop("tail")
        if n > 1:
            out = out.withColumn("context", F.substring("gram", order - n + 1, n - 1)).join(contexts[n - 1].select("context", F.col("back").alias(f"b{n}")), "context", "left").drop("context")
    p: Column = F.coalesce("p1", F.lit(floor))
    for n in range(2, order + 1):
        p = F.coalesce(F.col(f"p{n}"), F.coalesce(F.col(f"b{n}"), F.lit(1.0)) * p)
    return out.select("gram", F.log(p).alias("logp"))


@dataclasses.dataclass
class SmallModel:
    """A model as arrays: n-grams as numbers of 12 bits a symbol, sorted, with their natural-log probabilities and, by context, log back-off weights."""

    symbols: np.ndarray  # code points, sorted; symbol k + 1 is the k-th, 0 any other
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order from 1: (keys, log p)
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by order from 2: (keys of its n - 1 symbols, log back-off)
    floor: float


def small_model(probs: list[DataFrame], contexts: list[DataFrame], floor: float) -> SmallModel | None:
    """The tables as arrays, or None if they are counted to be too large to send."""
    tables = [*probs, *contexts[1:]]
    if sum(t.limit(MOST_ROWS + 1).count() for t in tables) > MOST_ROWS:
        return None
    points = sorted({START, STOP, *(r["gram"] for r in probs[0].limit(MOST_SYMBOLS + 1).collect())})
    if len(points) > MOST_SYMBOLS:
        return None
    symbols = np.array([ord(c) for c in points], np.int64)

    def arrays(table: DataFrame, gram: str, value: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = table.select(gram, value).toArrow()
        raw = "".join(got.column(gram).to_pylist()).encode("utf-32-le", "surrogatepass")
        codes = np.searchsorted(symbols, np.frombuffer(raw, "<u4").astype(np.int64)).reshape(-1, n) + 1
        keys = np.zeros(len(codes), np.int64)
        for k in range(n):
            keys = keys << 12 | codes[:, k]
        order = np.argsort(keys)
        return keys[order], np.log(got.column(value).to_numpy())[order]

    return SmallModel(symbols, [arrays(t, "gram", "p", n) for n, t in enumerate(probs, 1)], [arrays(t, "context", "back", n) for n, t in enumerate(contexts[1:], 1)], float(np.log(floor)))


class _Lookup:
    """Values by key: a half-empty table of hashed places, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            stays = np.ones(len(left), bool)
            stays[put] = False
            left, at = left[stays], (at[stays] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; values of keys that are not there are 0."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], 0.0)
        found = there == keys
        left = np.flatnonzero(~found & (there >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            stays = ~hit & (there >= 0)
            left, at = left[stays], at[stays]
        return found, out


class Reader:
    """Sums of log probabilities of texts under a SmallModel, many texts at a time."""

    def __init__(self, model: SmallModel):
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[model.symbols] = np.arange(1, len(model.symbols) + 1)
        self.grams = [_Lookup(*t) for t in model.grams]
        self.contexts = [_Lookup(*t) for t in model.contexts]
        self.floor, self.order = model.floor, len(model.grams)

    def sums(self, texts: list[str]) -> np.ndarray:
        """One sum for each text; an empty text's is 0."""
        order, pad = self.order, START * (self.order - 1)
        whole = "".join(f"{pad}{t}{STOP}" for t in texts)
        codes = self.symbol[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(lengths + order - 1) - (lengths + order - 1)
        ends = np.repeat(begins + order - 1, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # places of predicted symbols
        keys = codes[ends]
        for k in range(1, order):
            keys = keys | codes[ends - k] << 12 * k
        out = self._logs(keys)
        at = np.cumsum(lengths) - lengths
        return np.where(lengths > 1, np.add.reduceat(out, at) if len(texts) else out, 0.0)

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each `order`-gram: its own, or back-off weights times the longest shorter one's that there is."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for n in range(self.order, 0, -1):
            tail = keys[left] & ((1 << 12 * n) - 1)
            found, value = self.grams[n - 1].get(tail)
            out[left] += value
            left, tail = left[~found], tail[~found]
            if n > 1:
                out[left] += self.contexts[n - 2].get(tail >> 12)[1]  # a context that was never met backs off for nothing
            else:
                out[left] += self.floor
        return out


def read_texts(docs: DataFrame, model: SmallModel) -> DataFrame:
    """(doc_id, lang, mark, size, n_words, logp): each document (doc_id, lang, mark, text) read where it lies; `size` counts its symbols."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in small_batches(batches, 128):
            words = [WORDS.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            lines = [" ".join(w) for w in words]
            sums, held, size = [], [], 0
            for line in lines:  # a few million symbols at a time
                held.append(line)
                size += len(line)
                if size > 2_000_000:
                    sums.append(reader.sums(held))
                    held, size = [], 0
            if held:
                sums.append(reader.sums(held))
            sizes = [len(t) + 1 if t else 0 for t in lines]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(list(map(len, words)), pa.int64()), pa.array(np.concatenate(sums) if sums else [], pa.float64())], ["doc_id", "lang", "mark", "size", "n_words", "logp"])

    return docs.select("doc_id", "lang", "mark", "text").mapInArrow(run, "doc_id long, lang string, mark boolean, size long, n_words long, logp double")


def trusted_counts(docs: DataFrame, order: int, most_grams: int = 1_000_000) -> DataFrame:
    """(gram, c): how often each `order`-gram is in the text of marked documents. All of it counts; tasks sum their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[str] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], ["gram", "c"])
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                for grams in windows(" ".join(WORDS.findall(text)) if text else "", order):
                    known.update(grams)
            if len(known) >= most_grams:
                yield rows()
                known.clear()
        yield rows()

    return docs.where("mark").select("text").mapInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def distinct_words(words: DataFrame) -> DataFrame:
    """(shard, word): each distinct packed word of a shard once."""

    def unique(t: pa.Table) -> pa.Table:
        seen = sorted({w for packed in t.column("words").to_pylist() for w in unpack_words(packed)})
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()] * len(seen), pa.int32()), "word": pa.array(seen, pa.string())})

    return stage(words.groupBy("shard").applyInArrow(unique, "shard int, word string"), "kn-words")


def give_values(words: DataFrame, valued: DataFrame) -> DataFrame:
    """(block, shard, vals): log probabilities of the packed words of `words` from `valued` (shard, word, logp)."""

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("word").to_pylist(), right.column("logp").to_pylist(), strict=True))
        out = [pack([known[w] for w in unpack_words(packed)], "<f8") for packed in left.column("words").to_pylist()]
        return pa.table({"block": left.column("block"), "shard": left.column("shard"), "vals": pa.array(out, pa.binary())})

    return words.groupBy("shard").cogroup(valued.select("shard", "word", "logp").groupBy("shard")).applyInArrow(give, "block long, shard int, vals binary")


def judge(scored: DataFrame, quantile: float, slack: float, enough: int) -> DataFrame:
    """doc_id, n_words, perplexity, threshold, kept from doc_id, lang, mark, size, n_words, nll by the rule of `sequence_filter`."""
    known = scored.where("mark and nll is not null")
    by_lang = known.groupBy("lang").agg(F.percentile(F.round("nll", 3), F.lit(quantile)).alias("most"), F.count("*").alias("n")).where(F.col("n") >= enough)
    whole = known.agg(F.percentile(F.round("nll", 3), F.lit(quantile)).alias("most")).first()["most"]
    most = F.coalesce(F.col("most"), F.lit(whole).cast("double")) + slack + 2 / F.sqrt(F.col("size"))
    out = scored.join(by_lang.select(F.col("lang").alias("their"), "most"), F.col("lang") == F.col("their"), "left").withColumn("limit", F.when(F.col("size") > 0, most))
    kept = F.col("nll").isNotNull() & (F.col("limit").isNull() | (F.col("nll") <= F.col("limit")))
    return out.select("doc_id", "n_words", F.exp("nll").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text, mark: true for trusted ids, else null."""
    ids = stage(trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(ids_side(ids.withColumn("mark", F.lit(True))), "doc_id", "left")


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text, mark: true for trusted ids, else null."""
    ids = stage(trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(ids_side(ids.withColumn("mark", F.lit(True))), "doc_id", "left")


def windows(text: str, order: int) -> Iterator[list[str]]:
    """The `order`-grams of a text without line breaks, one for each of its characters and its end, in lists of bounded length."""
    padded, n = START * (order - 1) + text + STOP, len(text) + 1
    for at in range(0, n if text else 0, 1 << 16):
        yield [padded[j : j + order] for j in range(at, min(n, at + (1 << 16)))]


def index_texts(docs: DataFrame, order: int, shards: int, most_grams: int = 1_000_000) -> DataFrame:
    """Blocks of documents (doc_id, lang, mark, text): their words in order, and their distinct n-grams by shard.

    A block ends after BLOCK_CHARS characters or `most_grams` distinct n-grams. In `texts` a line is a document.
    """
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("mark", pa.bool_()), ("n_words", pa.int64())]))), ("texts", pa.binary()), ("shards", pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), counter()

        def closed(heads: list[dict], lines: list[str], seen: set[str]) -> pa.RecordBatch:
            dealt: dict[int, list[str]] = {}
            for g in sorted(seen):
                dealt.setdefault(shard_of(g, shards), []).append(g)
            packed = [{"shard": s, "words": pack_words(grams)} for s, grams in sorted(dealt.items())]
            return pa.RecordBatch.from_pylist([{"block": (part << 33) + next(made), "docs": heads, "texts": pack_words(lines), "shards": packed}], schema)

        heads, lines, chars, seen = [], [], 0, set()
        for batch in small_batches(batches):
            for doc_id, lang, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = WORDS.findall(text) if text else []
                heads.append({"doc_id": doc_id, "lang": lang, "mark": mark, "n_words": len(words)})
                lines.append(" ".join(words))
                for grams in windows(lines[-1], order):
                    seen.update(grams)
                chars += len(lines[-1]) + 200
                if chars >= BLOCK_CHARS or len(seen) >= most_grams:
                    yield closed(heads, lines, seen)
                    heads, lines, chars, seen = [], [], 0, set()
        if heads:
            yield closed(heads, lines, seen)

    return docs.select("doc_id", "lang", "mark", "text").mapInArrow(run, "block long, docs array<struct<doc_id:long,lang:string,mark:boolean,n_words:long>>, texts binary, shards array<struct<shard:int,words:binary>>")


def score_texts(blocks: DataFrame, values: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, mark, size, n_words, logp): each document of blocks of `index_texts` read through; `size` counts its symbols."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("shard").to_pylist(), right.column("vals").to_pylist(), strict=True))
        heads, sizes, sums = [], [], []
        for row in left.to_pylist():
            known: dict[str, float] = {}
            for s in row["shards"]:
                known.update(zip(unpack_words(s["words"]), unpack(got[s["shard"]], "<f8").tolist(), strict=True))
            for text in unpack_words(row["texts"]):
                sizes.append(len(text) + 1 if text else 0)
                sums.append(sum(sum(map(known.__getitem__, grams)) for grams in windows(text, order)))
            heads += row["docs"]
        column = lambda name, kind: pa.array([h[name] for h in heads], kind)
        return pa.table({"doc_id": column("doc_id", pa.int64()), "lang": column("lang", pa.string()), "mark": column("mark", pa.bool_()), "size": pa.array(sizes, pa.int64()), "n_words": column("n_words", pa.int64()), "logp": pa.array(sums, pa.float64())})

    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, "doc_id long, lang string, mark boolean, size long, n_words long, logp double")


def join_texts(docs: DataFrame, model: tuple[list[DataFrame], list[DataFrame], float], order: int) -> DataFrame:
    """As `read_texts`, for a model of any size: distinct n-grams of blocks are valued in joins that are sharded by n-gram, and the texts read with their block's values. Staged; the blocks are removed."""
    shards = partitions(docs.sparkSession)
    blocks = stage(index_texts(docs, order, shards), "texts")
    words = shard_words(blocks, shards)
    distinct = distinct_words(words)
    grams = distinct.withColumn("gram", F.col("word"))
    scores = stage(gram_scores(grams.select("gram"), model, order), "kn-scores")
    values = stage(give_values(words, grams.join(scores, "gram")), "kn-values")
    unstage(distinct)
    unstage(scores)
    out = stage(score_texts(blocks, values, order), "perplexities")
    unstage(blocks)
    unstage(values)
    return out


def sequence_filter(docs: DataFrame, trusted: DataFrame, quantile: float = 0.999, slack: float = 0.15, enough: int = 200, small: bool | None = None) -> DataFrame:
    """doc_id, n_words, perplexity, threshold, kept for each row of `docs` (doc_id, lang, text).

    `trusted` has the doc_ids of trusted text; all of it trains the model. A text is its words in order with a space
    between two; its symbols are those characters and an end, and perplexity is by symbol (null without words). A
    document is kept if its log perplexity is at most the `quantile` of that of its language's trusted documents
    (rounded to 0.001) plus `slack` and 2 / sqrt(symbols), room for short texts. A language with fewer than `enough`
    trusted documents, or a null one, takes the quantile of all of them; without trusted text all with words are kept.
    Null and empty texts have no words and are not kept; repeated rows are judged each.

    The model goes to the documents if its tables are counted to be small (MOST_ROWS, MOST_SYMBOLS), else the documents'
    n-grams go to the model; `small` forces one of the two. Trusted ids reach the documents by broadcast if they are few
    enough (`ids_side`).
    """
    ship(docs.sparkSession)
    told = marked(docs, trusted)
    counts = stage(trusted_counts(told, SEQUENCE_ORDER), "kn-counts")
    probs, contexts, floor = model_tables(counts, SEQUENCE_ORDER)
    sent = small_model(probs, contexts, floor) if small is not False else None
    if small and sent is None:
        raise ValueError("the model is too large to be sent to the documents")
    sums = stage(read_texts(told, sent), "perplexities") if sent is not None else join_texts(told, (probs, contexts, floor), SEQUENCE_ORDER)
    for t in (*probs, *contexts):
        unstage(t)
    return judge(sums.withColumn("nll", F.when(F.col("size") > 0, -F.col("logp") / F.col("size"))), quantile, slack, enough)
