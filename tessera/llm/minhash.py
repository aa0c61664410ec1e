"""Near-duplicate documents by 5-word shingles: banded MinHash, odd sketches of the samples, exact confirmation on full sets.

Documents with equal shingle sets form a class and only its smallest id goes on. A document's MinHash samples give band
keys (candidates) and are folded into an odd sketch, a bitmap of parities: the XOR population count of two sketches
estimates how many samples differ, most precisely at high similarity, and clears candidates before their full sets are
compared. No bucket is ever compared all against all:

1. Each bucket's members meet its hub, the member with the most bucket mates. Buckets that are one component are done.
2. In open buckets of at most SMALL members, members of different components meet; that is linear in the members.
3. Larger open buckets are gathered by their hubs' component into groups with one hub each, which all members meet.
   Documents that are still apart then meet only if they share one of the rarest elements of their *differences to the
   hub* (`prefix_places`): linked documents must, whatever their number, and near copies that differ each in their own
   way do not. Large places again meet a hub of theirs before the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import connected_components, ids_side, partitions, ship, small_batches, stage, unstage

#: 30 bands of 4 samples: a pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^30, about 1 in 100,000.
BANDS, ROWS = 30, 4
#: Samples folded into an odd sketch (the bands' are the first of them), and its bits. Two sketches of similarity 0.75
#: differ in about 201 bits (standard deviation 14.5 at most, simulated); FAR is five deviations above. Of pairs of
#: similarity 0.6 it clears 70 %, of those of 0.55 all but a few.
SAMPLES, SKETCH_BITS, FAR = 512, 1024, 274
#: Sets up to this size are also folded whole, each shingle being a sample: the XOR of two such sketches is the odd sketch
#: of the sets' symmetric difference, so its count is never above, and for near copies hardly below, that difference.
WHOLE = 1500
#: Bytes of text that one pass of the vectorised hashing takes at most.
CHUNK = 1_000_000
#: Members up to which a bucket's members are compared with each other.
SMALL = 48
#: Tokens of a group's documents that are counted together, about.
BLOCK_TOKENS = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x):
    """The finalizer of splitmix64, on arrays of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the 5-word shingles of texts, many texts at a time and long ones in pieces."""

    def __init__(self, width: int = 5):
        import numpy as np

        self.width = width
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.base = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.mult = [np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64)) for j in range(width)]

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.inverse)]), dtype=np.uint64)

    def _words(self, data: bytes):
        """(starts, hashes) of the words of bytes that end with white space."""
        import numpy as np

        raw = np.frombuffer(data.translate(_LOWER), np.uint8)
        self._grow(len(raw) + 1)
        edge = np.flatnonzero(np.diff(self.space[raw], prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[raw] * self.powers[: len(raw)], dtype=np.uint64)])
        return starts, _mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def _roll(self, words):
        import numpy as np

        n = len(words) - self.width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(self.width if n > 0 else 0):
            rolled += words[j : n + j] * self.mult[j]
        return _mix(rolled)

    def _one(self, words, rolled):
        import numpy as np

        if len(words) >= self.width:
            return np.unique(rolled)
        if len(words):
            return _mix(np.array([sum(int(h) * int(m) for h, m in zip(words, self.mult, strict=False)) + len(words) & (1 << 64) - 1], np.uint64))
        return np.zeros(0, np.uint64)

    def _chunk(self, texts: list[bytes]) -> list:
        import numpy as np

        starts, words = self._words(b"\n".join(texts) + b"\n")
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, bounds).tolist()  # a document's words are words[first[d] : first[d + 1]]
        rolled = self._roll(words)
        return [self._one(words[a:b], rolled[a : max(a, b - self.width + 1)]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def _long(self, text: bytes):
        """A long text's words are hashed piece by piece, cut before white space; a longer word is one piece."""
        import numpy as np

        at, parts = 0, []
        while at < len(text):
            end = at + CHUNK
            while end < len(text) and not self.space[text[end]]:
                end += 1
            parts.append(self._words(text[at:end] + b"\n")[1])
            at = end
        words = np.concatenate(parts)
        return self._one(words, self._roll(words))

    def sets(self, texts: list[str | None]) -> Iterator:
        part, size = [], 0
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            if part and size + len(data) > CHUNK:
                yield from self._chunk(part)
                part, size = [], 0
            if len(data) > CHUNK:
                yield self._long(data)
                continue
            part.append(data)
            size += len(data)
        if part:
            yield from self._chunk(part)


def sample_seeds():
    import numpy as np

    return (_mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash(shingles, seeds):
    """The MinHash samples of a set: for each odd seed, the smallest 32-bit product with the upper half of a shingle."""
    import numpy as np

    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(seeds), np.uint32(0xFFFFFFFF))
    for at in range(0, len(high), 1024):
        np.minimum(out, (high[None, at : at + 1024] * seeds[:, None]).min(1), out=out)
    return out.astype(np.uint64)


def odd_sketch(samples, spread: bool = True):
    """The parity bitmap of the samples, as SKETCH_BITS / 64 signed 64-bit integers; `spread` tells the samples' places apart."""
    import numpy as np

    if spread:
        samples = samples + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))
    at = _mix(samples) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch, whole) of (doc_id, text); the last three are null without shingles, `whole` also for sets over WHOLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler, seeds = Shingler(), sample_seeds()
        weigh = _mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
        salt = _mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))
        for batch in small_batches(batches):
            n, keys, bands, sketches, wholes = [], [], [], [], []
            for s in shingler.sets(batch.column(1).to_pylist()):
                n.append(len(s))
                wholes.append(odd_sketch(s, spread=False).tolist() if 0 < len(s) <= WHOLE else None)
                if not len(s):
                    keys.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                samples = minhash(s, seeds)
                bands.append(_mix((samples[: BANDS * ROWS].reshape(BANDS, ROWS) * weigh).sum(1, dtype=np.uint64) ^ salt).view(np.int64).tolist())
                sketches.append(odd_sketch(samples).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(wholes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands", "sketch", "whole"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, whole array<long>")


def sketch_distance(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


class Sets:
    """Full shingle sets of the documents that a comparison has asked for, each made from its text once and staged."""

    def __init__(self, docs: DataFrame):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
        self.parts: list[DataFrame] = []

    def of(self, ids: DataFrame) -> DataFrame:
        """(rep, shingles) of at least all `ids` (rep)."""
        for part in self.parts:
            ids = ids.join(part.select("rep"), "rep", "left_anti")
        new = stage(ids.select("rep").distinct(), "set-ids")

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            for batch in small_batches(batches):
                data = [s.tobytes() for s in shingler.sets(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["rep", "shingles"])

        if not new.isEmpty():
            rows = self.texts.join(ids_side(new), "rep", "left_semi").dropDuplicates(["rep"])
            self.parts.append(stage(rows.mapInArrow(shingle, "rep long, shingles binary"), "shingles"))
        unstage(new)
        out = self.parts[0] if self.parts else self.texts.where("false").selectExpr("rep", "cast(text as binary) as shingles")
        for part in self.parts[1:]:
            out = out.union(part)
        return out

    def drop(self) -> None:
        for part in self.parts:
            unstage(part)


def confirmed(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The staged pairs (a, b) whose full shingle sets are similar enough, compared set by set; staged."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in small_batches(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="mergesort")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    full = sets.of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
    wide = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    return stage(wide.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"), "links")


def most_apart(n: Column, m: Column, percent: int) -> Column:
    """The largest symmetric difference of two linked sets of these sizes."""
    return F.floor((n + m) * ((100 - percent) / (100 + percent)) + 1e-6)


def alike(p: str, q: str, percent: int) -> Column:
    """Whether neither the sizes nor the sketches of two heads (aliases `p` and `q`, with n, sketch, whole) rule out a link.

    Sketches of samples may differ in FAR bits; those of whole sets in no more than their difference, nor in more than
    six deviations above what a difference of that size gives.
    """
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    apart = most_apart(n, m, percent).cast("double")
    mean = SKETCH_BITS / 2 * (1 - F.exp(apart * (-2 / SKETCH_BITS)))
    spread = F.sqrt(F.greatest(SKETCH_BITS / 4 * (1 - F.exp(apart * (-4 / SKETCH_BITS))) - apart * F.exp(apart * (-4 / SKETCH_BITS)), F.lit(0.0)))
    exact = sketch_distance(F.col(f"{p}.whole"), F.col(f"{q}.whole")) <= F.least(apart, mean + 6 * spread + 2)
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & F.coalesce(exact, F.lit(True)) & (sketch_distance(F.col(f"{p}.sketch"), F.col(f"{q}.sketch")) <= FAR)


def cleared(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of heads (rep, n, sketch, whole), a < b, that may be linked (`alike`)."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    wide = pairs.join(heads.alias("p"), F.col("a") == F.col("p.rep")).join(heads.alias("q"), F.col("b") == F.col("q.rep"))
    return wide.where(alike("p", "q", percent)).select("a", "b")


def differences(members: DataFrame, sets: Sets) -> DataFrame:
    """(g, mode, rep, n, tokens) of `members` (g, rep), where g is a hub; tokens are shingle hashes.

    Mode 0 holds documents of similarity 0.25 or more with the hub; their tokens are the symmetric difference to it, at
    most 5 n + 1 of them. Mode 1 holds those of 0.5 or less; their tokens are their own shingles. Linked documents are
    in one mode together: by the triangle inequality of 1 - similarity, theirs with the hub differ by 0.25 at most
    (`percent` 75 or more).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in small_batches(batches, 64):
            out: list[tuple] = []
            for g, rep, hub, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                h, s = np.frombuffer(hub.as_buffer(), np.uint64), np.frombuffer(own.as_buffer(), np.uint64)
                both, times = np.unique(np.concatenate([h, s]), return_counts=True)
                same = int(np.count_nonzero(times == 2))
                if 4 * same >= len(both):
                    out.append((g.as_py(), 0, rep.as_py(), len(s), both[times == 1].view(np.int64)))
                if 2 * same <= len(both):
                    out.append((g.as_py(), 1, rep.as_py(), len(s), s.view(np.int64)))
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["g", "mode", "rep", "n", "tokens"])

    full = sets.of(members.select("rep"))
    wide = members.join(full.toDF("g", "hub"), "g").join(full.toDF("rep", "own"), "rep")
    return wide.select("g", "rep", "hub", "own").mapInArrow(run, "g long, mode int, rep long, n long, tokens array<long>")


def token_blocks(made: DataFrame) -> DataFrame:
    """(block, g, mode, reps, n, x, tokens, shards) of `made` (g, mode, salt, salts, rep, comp, n, tokens): runs of documents of one salt of a group.

    `tokens` are the documents' tokens one after the other, x of each; `shards` hold each distinct one of them once, by
    hash in as many shards as the group has salts, with the number of the block's documents that have it and the lowest
    and highest of their components. So a token that all documents of a group share is one entry of each block. A block
    is closed at BLOCK_TOKENS (a larger document is one by itself).
    """
    entry = [(c, pa.list_(pa.int64())) for c in ("token", "df", "low", "high")]
    schema = pa.schema([("block", pa.int64()), ("g", pa.int64()), ("mode", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("reps", "n", "x", "tokens")), ("shards", pa.list_(pa.struct([("shard", pa.int64()), *entry])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def closed() -> pa.RecordBatch:
            x = np.array([len(t) for t in lists], np.int64)
            flat, comps = np.concatenate(lists), np.repeat(np.array([h[1] for h in heads], np.int64), x)
            order = np.lexsort((comps, flat))
            flat_, comps = flat[order], comps[order]
            first = np.flatnonzero(np.diff(flat_, prepend=flat_[:1] - 1))  # the components of a token are in order from here
            df = np.diff(first, append=len(flat_))
            own = [flat_[first], df, comps[first], comps[first + df - 1]]
            shard = (_mix(own[0].view(np.uint64)) % np.uint64(key[3])).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            kinds, starts = np.unique(shard[by], return_index=True)
            cuts = pa.array([*starts, len(by)], pa.int32())
            shards = pa.StructArray.from_arrays([pa.array(kinds), *(pa.ListArray.from_arrays(cuts, pa.array(c[by], pa.int64())) for c in own)], ["shard", "token", "df", "low", "high"])
            lists_ = [pa.array([v], pa.list_(pa.int64())) for v in ([h[0] for h in heads], [h[2] for h in heads], x, flat)]
            return pa.RecordBatch.from_arrays([pa.array([(part << 33) + done], pa.int64()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *lists_, pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), shards)], schema=schema)

        part, done, key, heads, lists, size = TaskContext.get().partitionId(), 0, None, [], [], 0
        for batch in small_batches(batches, 64):
            columns = (batch.column(i).to_pylist() for i in range(7))
            for g, mode, salt, salts, rep, comp, n, tokens in zip(*columns, batch.column(7), strict=True):
                if heads and (key != (g, mode, salt, salts) or size >= BLOCK_TOKENS):
                    yield closed()
                    done, heads, lists, size = done + 1, [], [], 0
                key = (g, mode, salt, salts)
                heads.append((rep, comp, n))
                lists.append(tokens.values.to_numpy())
                size += len(lists[-1])
        if heads:
            yield closed()

    kinds = "block long, g long, mode int, reps array<long>, n array<long>, x array<long>, tokens array<long>, shards array<struct<shard:long,token:array<long>,df:array<long>,low:array<long>,high:array<long>>>"
    return made.select("g", "mode", "salt", "salts", "rep", "comp", "n", "tokens").mapInArrow(run, kinds)


def shared_tokens(blocks: DataFrame) -> DataFrame:
    """(block, shared, df): the tokens of each block that several components of its group have, and how many documents of the group have them.

    A task counts one shard of a group at a time; a shard has BLOCK_TOKENS entries, about, whatever the group's size.
    """

    def count(shard: pa.Table) -> pa.Table:
        import numpy as np

        token, df, low, high = (shard.column(c).combine_chunks() for c in ("token", "df", "low", "high"))
        block = np.repeat(shard.column("block").to_numpy(), pc.list_value_length(token).to_numpy())
        token, df, low, high = (c.flatten().to_numpy() for c in (token, df, low, high))
        distinct, at = np.unique(token, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, df)
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, at, low)
        np.maximum.at(most, at, high)
        keep = np.flatnonzero((least < most)[at])
        keep = keep[np.argsort(block[keep], kind="stable")]
        ids, starts = np.unique(block[keep], return_index=True)
        cuts = pa.array([*starts, len(keep)], pa.int32())
        return pa.table({"block": pa.array(ids, pa.int64()), "shared": pa.ListArray.from_arrays(cuts, pa.array(token[keep])), "df": pa.ListArray.from_arrays(cuts, pa.array(total[at[keep]]))})

    flat = blocks.select("block", "g", "mode", F.explode("shards").alias("s")).select("block", "g", "mode", "s.*")
    known = flat.groupBy("g", "mode", "shard").applyInArrow(count, "block long, shared array<long>, df array<long>")
    return known.groupBy("block").agg(F.collect_list(F.struct("shared", "df")).alias("k")).select("block", F.flatten("k.shared").alias("shared"), F.flatten("k.df").alias("df"))


def prefix_places(members: DataFrame, comps: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(g, mode, token, rep, n, x, u, short): places where documents of `members` (g, rep) that may be linked meet.

    Of two documents with token sets X and Y (`differences`), |X| <= |Y|, the sets' symmetric difference is that of the
    documents' shingles and, if they are linked, at most D = (n + m) (100 - percent) / (100 + percent). So they share at
    least (|X| + |Y| - D) / 2 tokens, and in any common order of the tokens one among the first D / 2 + 1 of X and D + 1
    of Y (the prefix filter). The order is by rarity within the group. Tokens that one component alone has come first:
    no two documents that are still apart share them, so the u of them only shorten the prefixes, to nothing for most.
    x is |X|; `short` marks the places in the prefix of a smaller partner. The least number shared is above 0 unless
    both documents are linked to the hub, which must be known by then. Frequencies are counted and brought back once for
    each token of a block (`token_blocks`), not for each document that has it.
    """
    spark = members.sparkSession
    made = stage(differences(members, sets).withColumn("x", F.size("tokens").cast("long")), "differences")
    salts = made.groupBy("g", "mode").agg(F.ceil(F.sum(F.col("x") + 1) / BLOCK_TOKENS).alias("salts"))
    own = made.where("x > 0").join(salts, ["g", "mode"]).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts"))
    own = own.join(comps.toDF("rep", "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    dealt = own.select("g", "mode", "salt", "salts", "rep", "comp", "n", "tokens").repartition(partitions(spark), "g", "mode", "salt").sortWithinPartitions("g", "mode", "salt")
    blocks = stage(token_blocks(dealt), "token-blocks")
    unstage(made)
    rate = (100 + percent) / percent * (100 - percent) / (100 + percent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in small_batches(batches, 1):
            g, mode = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            reps, n, x, tokens, known, df = (batch.column(i)[0].values.to_numpy() for i in range(2, 8))
            by = np.argsort(known)
            known, df = known[by], df[by]
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            keep = known[at] == tokens
            doc, token, df = np.repeat(np.arange(len(reps)), x)[keep], tokens[keep], df[at[keep]]
            many = np.bincount(doc, minlength=len(reps))
            order = np.lexsort((token, df, doc))
            place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            u, most = x - many, np.floor(n * rate + 1e-6).astype(np.int64)  # D, as m <= 100 n / percent
            inside = place < (most - u + 1)[doc]
            doc, token, place = doc[inside], token[order][inside], place[inside]
            columns = [pa.array(np.full(len(doc), g), pa.int64()), pa.array(np.full(len(doc), mode), pa.int32()), *(pa.array(c, pa.int64()) for c in (token, reps[doc], n[doc], x[doc], u[doc])), pa.array(place < (most // 2 - u + 1)[doc])]
            yield pa.RecordBatch.from_arrays(columns, ["g", "mode", "token", "rep", "n", "x", "u", "short"])

    known = blocks.join(shared_tokens(blocks), "block").select("g", "mode", "reps", "n", "x", "tokens", "shared", "df")
    out = stage(known.mapInArrow(prefixes, "g long, mode int, token long, rep long, n long, x long, u long, short boolean"), "places")
    unstage(blocks)
    return out


def hubs_of(places: DataFrame, keys: list[str], best: Column, comp: Column) -> DataFrame:
    """(keys, hub, hub_comp): of each place the member with the largest `best`, the smallest id on a tie, and its component."""
    top = places.groupBy(*keys).agg(F.max(F.struct(best.alias("best"), (-F.col("rep")).alias("low"), comp.alias("comp"))).alias("top"))
    return top.select(*keys, (-F.col("top.low")).alias("hub"), F.col("top.comp").alias("hub_comp"))


def gathered(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(g, rep) of `members` (hub, rep): hubs of one component give their members to the one among them that has most."""
    sizes = members.groupBy("hub").agg(F.count("*").alias("n")).join(comps.toDF("hub", "component"), "hub", "left").withColumn("component", F.coalesce("component", "hub"))
    lead = sizes.groupBy("component").agg(F.max(F.struct("n", (-F.col("hub")).alias("low"))).alias("top")).select("component", (-F.col("top.low")).alias("g"))
    return members.join(sizes.join(lead, "component").select("hub", "g"), "hub").select("g", "rep").distinct()


def parted(places: DataFrame, comps: DataFrame, keys: list[str]) -> DataFrame:
    """Places with their members' component `comp`, without those that are one component; `size` is the number of members."""
    now = places.join(comps.toDF("rep", "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    open_ = now.groupBy(*keys).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high").select(*keys, "size")
    return now.join(open_, keys)


class Links:
    """Links found so far, and the components that they make."""

    def __init__(self, spark, sets: Sets, percent: int):
        self.sets, self.percent = sets, percent
        self.comps = spark.createDataFrame([], "id long, component long")

    def add(self, pairs: DataFrame) -> None:
        """Confirm `pairs` (a, b) and join the components that they link."""
        pairs = stage(pairs, "pairs")
        if not pairs.isEmpty():
            good = confirmed(pairs, self.sets, self.percent)
            old = self.comps
            edges = good.union(old.where("id <> component").toDF("a", "b"))
            self.comps = connected_components(edges)
            unstage(good)
            unstage(old)
        unstage(pairs)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    Words are what white space (U+0020, U+0009 to U+000D) parts, A-Z in lower case; two documents are linked if
    100 * |intersection| >= percent * |union| of their distinct 5-word shingles (a text of fewer words is one shingle);
    `percent` is 75 at least. Texts without words, and null ids, are linked with nothing; a null id has a null component
    and stays. Repeated rows of one id are one document and get the same result each. kept: the id is the smallest of its
    component. Texts are read whole; rows move as 8-byte keys and small sketches, and full sets only for candidates.
    Links are exact; a pair of documents that shares no band (1 in 100,000 at similarity 0.75, fewer above) is not looked at.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    spark = docs.sparkSession
    ship(spark)
    signed = stage(signatures(docs), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = stage(full.select("doc_id", "set_key").distinct().join(classes, "set_key").select("doc_id", "rep"), "members")
    copies = stage(members.groupBy("doc_id").agg(F.min(F.col("rep") == F.col("doc_id")).alias("first")).where("not first").select("doc_id"), "copies")
    reps = full.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch", "whole").join(ids_side(copies.withColumnRenamed("doc_id", "rep")), "rep", "left_anti")
    exploded = reps.select("rep", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("mates"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "mates")
    buckets = stage(exploded.join(shared, "band"), "buckets")  # a row for each member of a bucket of two or more
    popular = buckets.join(buckets.groupBy("rep").agg(F.sum("mates").alias("pop")), "rep")
    places = stage(buckets.select("band", "rep").join(hubs_of(popular, ["band"], F.col("pop"), F.col("rep")).drop("hub_comp"), "band"), "bands")
    heads = reps.select("rep", "n", "sketch", "whole").join(buckets.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"])
    heads = stage(heads, "heads")
    unstage(buckets)
    sets = Sets(docs)
    links = Links(spark, sets, percent)
    links.add(cleared(places.select(F.col("rep").alias("a"), F.col("hub").alias("b")), heads, percent))
    left = stage(parted(places, links.comps, ["band"]), "open")
    if not left.isEmpty():
        few = left.where(F.col("size") <= SMALL).join(heads, "rep").select("band", "rep", "comp", "n", "sketch", "whole")
        two = few.alias("p").join(few.alias("q"), (F.col("p.band") == F.col("q.band")) & (F.col("p.comp") < F.col("q.comp")) & alike("p", "q", percent))
        links.add(two.select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")).distinct())
        many = left.where(F.col("size") > SMALL).select("hub", "rep")
        if not many.isEmpty():
            many = stage(gathered(many.distinct(), links.comps), "groups")
            links.add(cleared(many.select(F.col("rep").alias("a"), F.col("g").alias("b")), heads, percent))
            keys = ["g", "mode", "token"]
            spots = prefix_places(many, links.comps, sets, percent)
            wide = parted(spots, links.comps, keys).where(F.col("size") > SMALL)
            wide = wide.select(*keys, "rep", "comp").join(hubs_of(wide, keys, -F.col("x"), F.col("comp")), keys).where("comp <> hub_comp")
            links.add(cleared(wide.select(F.col("rep").alias("a"), F.col("hub").alias("b")), heads, percent))
            rest = stage(parted(spots, links.comps, keys).drop("size"), "places")
            main = rest.groupBy(*keys, "comp").agg(F.count("*").alias("many")).groupBy(*keys).agg(F.max(F.struct("many", "comp")).alias("top")).select(*keys, F.col("top.comp").alias("main"))
            rest = rest.join(main, keys).join(heads.drop("n"), "rep")
            bound = most_apart(F.col("p.n"), F.col("q.n"), percent)
            near = (F.col("p.u") + F.col("q.u") <= bound) & (F.col("q.x") - F.col("p.x") <= bound) & (F.col("p.x") + F.col("q.x") - bound <= 2 * F.least(F.col("p.x") - F.col("p.u"), F.col("q.x") - F.col("q.u")))
            first = F.struct("p.x", "p.rep") < F.struct("q.x", "q.rep")
            same = (F.col("p.g") == F.col("q.g")) & (F.col("p.mode") == F.col("q.mode")) & (F.col("p.token") == F.col("q.token"))
            may = same & first & (F.col("p.comp") != F.col("q.comp")) & near & alike("p", "q", percent)
            # members of a place's largest component do not meet each other
            two = rest.where("short and comp <> main").alias("p").join(rest.alias("q"), may).select("p.rep", F.col("q.rep").alias("other"))
            two = two.union(rest.where("short and comp = main").alias("p").join(rest.where("comp <> main").alias("q"), may).select("p.rep", F.col("q.rep").alias("other")))
            links.add(two.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct())
            unstage(spots)
            unstage(many)
    for done in (left, places, heads):
        unstage(done)
    sets.drop()
    found = members.join(links.comps.toDF("rep", "component"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
