"""Token-id files: whole texts to ids, ids to checksummed blocks of a range coder, and back.

A table of texts becomes one stream of ids in the order of document ids, each document ended by an end id. The stream is
cut by ranges of document ids into files and each file into blocks of a fixed number of ids, coded one by one
(range_coder). A file is a Parquet part whose rows are its blocks in order: `data`, the block's own bytes with header and
checksums, and `pieces`, saying which documents' ids it holds; Spark's writer makes each part appear whole or not at all,
whichever executors are lost. Readers take any part, any row group or any block alone.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import crc_algebra
from .range_coder import BadBlock, BlockCoder
from .workspace import partitions, shared_dir, ship, small_batches, stage, unstage

__all__ = ["IdEncoder", "document_digests", "encode_texts", "read_ids", "write_ids", "write_texts"]

#: Pieces whose ids a worker keeps. Beyond it the older half is forgotten, which costs time and changes nothing.
MOST_PIECES = 1_000_000
#: Bytes of text that are split at once (a longer text is split alone), and bytes of the longest piece that is kept.
PART_BYTES, LONGEST_KEPT = 1 << 20, 24
BLOCK_IDS, LANES = 4096, 2048
PIECE = "struct<doc_id:{kind}, start:bigint, total:bigint, at:bigint, n:int>"
#: Of each worker process: encoders by the checksum of their file, kept from task to task.
_encoders: dict[int, IdEncoder] = {}


def id_kind(vocabulary: int) -> str:
    """The NumPy name of the bytes that ids travel in until they are coded."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


OTHER, LETTER, DIGIT, SIGN, SPACE = range(5)
PAD = 32  # bytes that may be read beyond the last text
#: Odd multipliers of the pieces' hash, from the fractions of square roots. Fixed values.
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of characters of two bytes by both bytes. OTHER: the plain rules of `_cuts` may not hold for it."""
    one, two = np.zeros(256, np.uint8), np.zeros(1 << 16, np.uint8)
    one[0x21:0x7F] = SIGN
    one[[*b"\t\n\r "]] = SPACE
    one[[*b"0123456789"]] = DIGIT
    one[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    for point in (*range(0xA1, 0xAA), *range(0xAB, 0xB2), 0xB4, *range(0xB6, 0xB9), 0xBB, *range(0xBF, 0x250)):
        high, low = chr(point).encode("utf-8")
        two[high << 8 | low] = LETTER if chr(point).isalpha() else SIGN
    return one, two


ONE_BYTE, TWO_BYTES = _classes()
#: Signs of three bytes: U+2010 to U+2027, U+2030 to U+2049, the euro and the trade mark.
THREE_BYTES = np.array([int.from_bytes(chr(p).encode("utf-8"), "big") for p in (*range(0x2010, 0x2028), *range(0x2030, 0x204A), 0x20AC, 0x2122)])
MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for n in range(LONGEST_KEPT + 1)] for k in range(3)], np.uint64)


def _hashes(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces given as three rows of words."""
    h = keys[0] * MIX[0]
    h ^= h >> np.uint64(29)
    h += keys[1] * MIX[1]
    h ^= h >> np.uint64(32)
    h += keys[2] * MIX[2]
    h ^= h >> np.uint64(29)
    h *= MIX[3]
    return h


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of places, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _cuts(b: np.ndarray, n: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a piece starts at each of `n` bytes of UTF-8 in `b` (PAD more bytes follow), and the bytes that are OTHER; texts start at `rows`.

    Pieces are runs of letters, digits or signs with one space before, contractions, and white space, which leaves its last
    character to what follows: as the library's pattern has them in texts of ASCII, Latin letters and common signs.
    """
    cls = ONE_BYTE.take(b)
    lead = np.flatnonzero(b[:n] >= 0xC2)
    if len(lead):
        cls[lead] = cls[lead + 1] = TWO_BYTES.take(b[lead].astype(np.int64) << 8 | b[lead + 1])
        three = lead[b[lead] == 0xE2]
        sign = np.where(np.isin(b[three].astype(np.int64) << 16 | b[three + 1].astype(np.int64) << 8 | b[three + 2], THREE_BYTES), SIGN, OTHER)
        cls[three] = cls[three + 1] = cls[three + 2] = sign
    first = np.zeros(n + PAD, bool)
    first[rows] = True
    white = cls == SPACE
    start = np.zeros(n + PAD, bool)
    start[1:] = (cls[1:] != cls[:-1]) & (b[:-1] != 0x20)
    last = white[1:-1] & white[:-2] & ~white[2:]
    last &= ~first[2:]
    last[n - 2 :] = False  # the last white space of the last text
    start[1:-1] |= last
    start |= first
    quote = np.flatnonzero((b[:n] == 0x27) & start[:n])
    if len(quote):
        x, y = b[quote + 1], b[quote + 2]
        short = ((x == 0x73) | (x == 0x74) | (x == 0x6D) | (x == 0x64)) & ~first[quote + 1]
        long = (((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)) & ~first[quote + 1] & ~first[quote + 2]
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    return start[:n], np.flatnonzero(cls[:n] == OTHER)


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian bytes: `kind` is uint16 for vocabularies of up to 65,536, else uint32.

    Texts are cut to pieces where the library would cut them (`_cuts`), many at once; a piece's ids are made once, by the
    library's own BPE model, and kept in a hash table of NumPy rows: three words with the piece's own bytes, and where its
    ids are. Texts with other characters or special tokens go through the library whole.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        made = json.loads(spec)
        if made.get("normalizer") or made["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        self.library = Tokenizer.from_str(spec.decode("utf-8"))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = Tokenizer.from_str(spec.decode("utf-8")).model  # its own, for the library keeps pieces that are kept here already
        self.model._resize_cache(0)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = id_kind(self.size)
        self.specials = [t["content"].encode("utf-8") for t in made["added_tokens"]]
        keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = itertools.count(0x100)
        self.symbols = np.array([b if b in keep else next(spare) for b in range(256)], "<u2")  # the printable stand-in of each byte
        self._clear(1 << 12)

    def _clear(self, slots: int) -> None:
        self.table = np.zeros((slots, 4), np.uint64)  # three words of bytes; place of the ids << 24 | their number (0: free)
        self.ids, self.used, self.pieces = np.zeros(4 * slots, self.kind), 0, 0

    def _add(self, ids: np.ndarray) -> int:
        """Put ids behind the kept ones; where they are. They stay if `used` is moved beyond them."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (_hashes(keys) >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _enter(self, rows: np.ndarray) -> None:
        """Enter rows of the table whose keys are new and differ."""
        self.pieces += len(rows)
        at, wrap = self._slots(rows[:, :3].T), len(self.table) - 1
        while len(rows):
            _, winner = np.unique(at, return_index=True)
            winner = winner[self.table[at[winner], 3] == 0]
            self.table[at[winner]] = rows[winner]
            rest = np.ones(len(rows), bool)
            rest[winner] = False
            rows, at = rows[rest], at[rest] + 1 & wrap

    def _room(self, more: int) -> bool:
        """Make room for `more` pieces: forget the older half of too many, and keep half of the table free. Whether kept ids moved."""
        if self.pieces + more <= min(MOST_PIECES, len(self.table) // 2):
            return False
        rows, ids = self.table[self.table[:, 3] != 0], self.ids[: self.used].copy()
        if self.pieces + more > MOST_PIECES:
            rows = rows[np.argsort(rows[:, 3])][(len(rows) + 1) // 2 :]
            n = (rows[:, 3] & np.uint64(0xFFFFFF)).astype(np.int64)
            ids = ids.take(_runs((rows[:, 3] >> np.uint64(24)).astype(np.int64), n))
            rows[:, 3] = (np.cumsum(n) - n << 24 | n).astype(np.uint64)
        slots = 1 << 12
        while slots < 2 * (len(rows) + more):
            slots *= 2
        self._clear(slots)
        self.used = len(ids) + self._add(ids)
        self._enter(rows)
        return True

    def _grow(self, more: int) -> None:
        """A larger table, whatever MOST_PIECES says; kept ids stay where they are."""
        rows, slots = self.table[self.table[:, 3] != 0], len(self.table)
        while slots < 2 * (len(rows) + more) + 2:
            slots *= 2
        self.table, self.pieces = np.zeros((slots, 4), np.uint64), 0
        self._enter(rows)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The last words of the rows with these keys; 0: not kept."""
        at, wrap = self._slots(keys), len(self.table) - 1
        out, open_ = np.zeros(keys.shape[1], np.uint64), None
        while True:
            row = self.table.take(at, axis=0)
            same = (row[:, 0] == keys[0]) & (row[:, 1] == keys[1]) & (row[:, 2] == keys[2])
            if open_ is None:
                np.copyto(out, row[:, 3], where=same)
                open_ = np.arange(len(out))
            else:
                out[open_[same]] = row[same, 3]
            on = np.flatnonzero(~same & (row[:, 3] != 0))
            if not len(on):
                return out
            open_, at, keys = open_[on], at[on] + 1 & wrap, keys[:, on]

    def _made(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces without NUL by the library's model."""
        joined = np.frombuffer(b"\0".join(pieces), np.uint8)
        spelled = self.symbols.take(joined).tobytes().decode("utf-16-le").split(chr(self.symbols[0]))
        return [[t.id for t in self.model.tokenize(p)] for p in spelled]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Make and keep the ids of new pieces, which differ."""
        made = self._made(pieces)
        n = np.array([len(m) for m in made], np.int64)
        start = self._add(np.fromiter(itertools.chain.from_iterable(made), self.kind, int(n.sum())))
        self.used += int(n.sum())
        self._enter(np.column_stack([*keys, (start + np.cumsum(n) - n << 24 | n).astype(np.uint64)]))

    def _part(self, b: np.ndarray, n: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in `n` bytes of `b`, one after another, and their number in each; `rows`: where texts start, and the end of the last."""
        start, other = _cuts(b, n, rows[:-1][rows[:-1] < n])
        text = b[:n].tobytes()
        for special in self.specials:
            found = text.find(special)
            while found >= 0:
                other, found = np.append(other, found), text.find(special, found + 1)
        at = np.flatnonzero(start)
        size = np.diff(at, append=n)
        of_row = np.searchsorted(at, rows)  # the pieces of each text
        whole = np.unique(np.searchsorted(rows, other, "right") - 1)  # texts that the library takes whole
        if len(whole):
            drop = np.zeros(len(rows) - 1, bool)
            drop[whole] = True
            pieces = np.diff(of_row)
            stay = np.repeat(~drop, pieces)
            at, size, of_row = at[stay], size[stay], np.concatenate([[0], np.cumsum(np.where(drop, 0, pieces))])
        words = np.ndarray(n + PAD - 7, "<u8", b, strides=(1,))
        kept = np.minimum(size, LONGEST_KEPT)
        keys = np.stack([words[at + 8 * k] & MASKS[k].take(kept) for k in range(3)])
        long = np.flatnonzero(size > LONGEST_KEPT)
        keys[:, long] = 0  # no piece has such a key; these are made anew
        where = self._find(keys)
        where[long] = 1
        new = np.flatnonzero(where == 0)
        if len(new) and self._room(len(np.unique(_hashes(keys[:, new])))):
            where = self._find(keys)
            where[long] = 1
            new = np.flatnonzero(where == 0)
        while len(new):
            _, one = np.unique(_hashes(keys[:, new]), return_index=True)
            one = new[one]
            if 2 * (self.pieces + len(one)) > len(self.table) - 2:  # forgotten pieces came again
                self._grow(len(one))
            self._learn(keys[:, one], [text[i:j] for i, j in zip(at[one].tolist(), (at[one] + size[one]).tolist(), strict=True)])
            where[new] = self._find(keys[:, new])
            new = new[where[new] == 0]
        starts, n_ids = (where >> np.uint64(24)).astype(np.int64), (where & np.uint64(0xFFFFFF)).astype(np.int64)
        if len(long):  # their ids lie behind the kept ones until this part is done
            made = self._made([text[i:j] for i, j in zip(at[long].tolist(), (at[long] + size[long]).tolist(), strict=True)])
            n_ids[long] = [len(m) for m in made]
            first = self._add(np.fromiter(itertools.chain.from_iterable(made), self.kind, int(n_ids[long].sum())))
            starts[long] = first + np.cumsum(n_ids[long]) - n_ids[long]
        ids = self.ids.take(_runs(starts, n_ids))
        ends = np.concatenate([[0], np.cumsum(n_ids)])[of_row]
        counts = np.diff(ends)
        if not len(whole):
            return ids, counts
        texts = np.split(ids, ends[1:-1])
        for k in whole.tolist():
            texts[k] = np.array(self.library.encode(text[rows[k] : rows[k + 1]].decode("utf-8"), add_special_tokens=False).ids, self.kind)
            counts[k] = len(texts[k])
        return np.concatenate(texts), counts

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """Ids of every text (null: empty) as bytes, each with `end_id` after them (None: nothing)."""
        column = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        made, counts, k = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], 0
        while k < len(column):
            to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PART_BYTES, "right")) - 1)
            n = int(bounds[to] - bounds[k])
            if n:
                b = np.zeros(n + PAD, np.uint8)
                b[:n] = data[bounds[k] : bounds[to]]
                ids, number = self._part(b, n, bounds[k : to + 1] - bounds[k])
            else:
                ids, number = made[0], np.zeros(to - k, np.int64)
            made.append(ids)
            counts.append(number)
            k = to
        ids, number = np.concatenate(made), np.concatenate(counts)
        if end_id is not None:
            is_end = np.zeros(len(ids) + len(number), bool)
            is_end[np.cumsum(number + 1) - 1] = True
            with_ends = np.empty(len(is_end), self.kind)
            with_ends[~is_end], with_ends[is_end] = ids, end_id
            ids, number = with_ends, number + 1
        offsets = np.concatenate([[0], np.cumsum(number)]) * ids.itemsize
        if offsets[-1] >= 1 << 31:
            raise ValueError("2 GB of ids in one Arrow batch")
        return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


def _encoder(spec: bytes) -> IdEncoder:
    key = zlib.crc32(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = IdEncoder(spec)
    return _encoders[key]


def _encoding(spec, end_id: int | None):
    """For mapInArrow over (doc_id, text): (doc_id, ids). `spec`: the tokenizer file, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(spec.value)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), coder.encode_all(batch.column(1), end_id)], ["doc_id", "ids"])

    return run


def _spec(spark: SparkSession, tokenizer_path: str):
    with open(tokenizer_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # as large as one tokenizer file


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: little-endian bytes of id_kind) of every row, with `end_id` after each (None: nothing). Null and empty texts have the end id alone."""
    ship(docs.sparkSession)
    run = _encoding(_spec(docs.sparkSession, tokenizer_path), end_id)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def _blocks(vocabulary: int, block: int, kind: pa.DataType):
    """For mapInArrow over (doc_id, ids) in order: the file's blocks, coded in groups of LANES."""
    piece = pa.struct([("doc_id", kind), ("start", pa.int64()), ("total", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
    names = ["file", "block", "first", "n_ids", "pieces", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, kind_of_ids = BlockCoder(vocabulary, LANES), TaskContext.get().partitionId(), id_kind(vocabulary)
        waiting: list[np.ndarray] = []  # ids not yet in a block
        have, position, done = 0, 0, 0
        full: list[np.ndarray] = []
        pieces: list[list[dict]] = [[]]

        def cut() -> None:
            nonlocal waiting, have
            joined = np.concatenate(waiting)
            for at in range(0, have - block + 1, block):
                full.append(joined[at : at + block])
            waiting, have = [joined[have - have % block :]], have % block

        def coded() -> pa.RecordBatch:
            nonlocal full, pieces, done
            sizes = [len(b) for b in full]
            firsts = [done * block + block * k for k in range(len(full))]
            out = pa.RecordBatch.from_arrays([pa.array([file] * len(full), pa.int32()), pa.array(range(done, done + len(full)), pa.int64()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(pieces[: len(full)], pa.list_(piece)), pa.array(coder.encode(full), pa.binary())], names)
            done, pieces, full = done + len(full), pieces[len(full) :], []
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), kind_of_ids)
                start, total, at = position, len(ids), 0
                while at < total:  # the document's ids by block
                    room = block - position % block
                    n = min(room, total - at)
                    pieces[-1].append({"doc_id": doc_id, "start": start, "total": total, "at": at, "n": n})
                    at, position = at + n, position + n
                    if n == room:
                        pieces.append([])
                waiting.append(ids)
                have += total
                if have >= block * 64:
                    cut()
                    if len(full) >= LANES:
                        yield coded()
        if have >= block:
            cut()
        if have:
            full.append(np.concatenate(waiting))
        if full:
            yield coded()

    return run


def _written(rows: DataFrame, column: str, path: str, files: int | None, steps: list) -> None:
    """Write (doc_id, `column`) at `path`, dealt to files by ranges of (doc_id, hash of the column) and ordered in them, after `steps` of mapInArrow, done in one pass. The last gives blocks."""
    ship(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    tied = rows.select("doc_id", column, F.xxhash64(column).alias("tie"))
    dealt = tied.repartitionByRange(files or partitions(rows.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    schema = f"file int, block long, first long, n_ids int, pieces array<{PIECE.format(kind=kind)}>, data binary"
    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def write_ids(encoded: DataFrame, path: str, vocabulary: int, block: int = BLOCK_IDS, files: int | None = None) -> None:
    """Write rows (doc_id, ids) of at least one id each to `files` files at `path` in the order of doc_id: nulls first, rows of one id ordered by a hash of their ids.

    Files are ranges of (doc_id, hash), so that rows that share an id may be parted. A task holds LANES blocks.
    """
    _written(encoded, "ids", path, files, [_blocks(vocabulary, block, to_arrow_type(encoded.schema["doc_id"].dataType))])


def write_texts(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, block: int = BLOCK_IDS, files: int | None = None) -> None:
    """Encode texts and write their ids as `write_ids` does, in one pass: texts are put in order first, rows of one id by a hash of their texts, so ids are never stored plain."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    steps = [_encoding(_spec(docs.sparkSession, tokenizer_path), end_id), _blocks(vocabulary, block, to_arrow_type(docs.schema["doc_id"].dataType))]
    _written(docs, "text", path, files, steps)


def _read(spark: SparkSession, path: str, vocabulary: int, ids: bool) -> DataFrame:
    """A row for each piece of a document in a block: file, doc_id, start, total, at, n, crc (its share of the document's CRC) and, if asked, ids."""
    ship(spark)
    stored = spark.read.parquet(path).select("file", "block", "pieces", "data")
    kind = stored.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockCoder(vocabulary, LANES)
        for batch in _gathered(batches, LANES):
            try:
                blocks = coder.decode([d.as_buffer().to_pybytes() for d in batch.column("data")])
            except BadBlock as e:
                raise BadBlock(f"{e}; file {batch.column(0)[0]}, blocks {batch.column(1)[0]} to {batch.column(1)[-1]}") from e
            pieces = batch.column("pieces").combine_chunks()
            flat = pa.RecordBatch.from_struct_array(pieces.flatten())
            row = np.repeat(np.arange(batch.num_rows), pieces.value_lengths().to_numpy())
            n, at, total = (flat.column(x).to_numpy(zero_copy_only=False) for x in ("n", "at", "total"))
            parts = np.split(np.concatenate(blocks).astype("<u4"), np.cumsum(n)[:-1])
            crcs = np.fromiter((zlib.crc32(p.tobytes()) for p in parts), np.uint32, len(parts))
            share = crc_algebra.shift(crcs, 4 * (total - at - n)).astype(np.int64)
            columns = [batch.column("file").combine_chunks().take(pa.array(row)), *flat.columns, pa.array(share)]
            if ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["file", *flat.schema.names, "crc", "ids"][: len(columns)])

    return stored.mapInArrow(run, f"file int, doc_id {kind}, start long, total long, at long, n int, crc long" + ", ids array<int>" * ids)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of `rows` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        while batch.num_rows:
            take = min(rows - have, batch.num_rows)
            held.append(batch.slice(0, take))
            have, batch = have + take, batch.slice(take)
            if have == rows:
                yield pa.Table.from_batches(held)
                held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, before): ids of all earlier files. The driver adds up one number for each file."""
    sizes = {r["file"]: r["n"] for r in spark.read.parquet(path).groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    before = list(itertools.accumulate((sizes[f] for f in sorted(sizes)), initial=0))
    return spark.createDataFrame(list(zip(sorted(sizes), before, strict=False)), "file int, before long")


def read_ids(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, at, ids): the documents' ids in pieces; `start` counts the ids of all documents before, `at` those of the document before the piece."""
    return _read(spark, path, vocabulary, True).join(F.broadcast(_file_starts(spark, path)), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "at", "ids")


def document_digests(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded blocks. Shares of documents that span blocks are put together by exclusive or, in any order."""
    pieces = stage(_read(spark, path, vocabulary, False), "id-pieces")  # decoded once for both uses
    whole = pieces.where("n = total").select("file", "doc_id", "start", "total", "crc")
    parted = pieces.where("n < total").groupBy("file", "doc_id", "start", "total").agg(F.expr("bit_xor(crc)").alias("crc"), F.sum("n").alias("n"))
    checked = parted.select("file", "doc_id", "start", "total", F.when(F.col("n") == F.col("total"), F.col("crc")).otherwise(F.raise_error(F.lit("a document lacks blocks"))).alias("crc"))
    rows = whole.union(checked).join(F.broadcast(_file_starts(spark, path)), "file")
    out = stage(rows.select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("total").alias("n_tokens"), F.col("crc").alias("ids_crc32")), "id-digests")
    unstage(pieces)
    return out


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None, block: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Encode `docs`, write the files at `path` (default: a new one in the shared folder), and read back (doc_id, start, n_tokens, ids_crc32) for each row.

    Null and empty texts are the end id alone; rows of one id are documents of their own, those of a null id come first;
    an empty table gives no rows. Texts are shuffled once, ids are written once, coded.
    """
    import uuid

    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    path = path or f"{shared_dir(spark)}/tessera/ids-{uuid.uuid4().hex}"
    write_texts(docs, tokenizer_path, path, end_id, block, files)
    return document_digests(spark, path, vocabulary)
