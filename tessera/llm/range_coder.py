"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own, from an empty model. Three orders predict the next id: order 2 and order 1 each the id that
last followed the same two ids or the same one (with a confidence of 0 to 3), order 0 the frequencies of the block's ids
so far. How the orders share the range depends on both confidences and on whether they agree; the shares are mixed anew
from what came true in this block, and the order-0 frequencies are taken anew, each time the block has doubled. An id that
no order predicts is escaped and coded plainly. A range coder of 56 bits with words of 28 bits, two in seven bytes, carries the decisions.

The ids that followed are kept in rows by the last id: one entry of order 1 and three of order 2, chosen by the id before,
so that both orders are found in one place of memory. Blocks are independent, so many are coded at once, each being one lane of NumPy arrays; all arithmetic is on integers, so
every machine gives the same bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

__all__ = ["BadBlock", "BlockCoder"]

HEADER = struct.Struct("<4sBBxxIII")  # magic, version, bits of an id, ids, CRC-32 of the ids as uint32, CRC-32 of header and words
MAGIC, VERSION = b"TIDB", 2
U = np.uint64
WORD_BITS = U(28)  # the range has 28 to 56 bits between ids; words of 28 bits leave it at the top
LEAST, WORD = U(1 << 28), U((1 << 28) - 1)
SHARE_BITS, CONTEXTS, OUTCOMES = 12, 32, 4  # outcomes: order 2, order 1, order 0, escape
LEAST_SHARES = np.array([1, 1, 1, 64])  # in 4096; with 64, an escaped id of up to 22 bits still has a range of its own
FIRST_RENEWAL, MOST_IDS, TABLE_BITS = 32, 1 << 15, 9
STRETCH = 128  # ids of all lanes whose decisions are held at once
#: Hash multiplier of the contexts: an odd number near the golden ratio's fraction. Fixed value.
ONE = np.uint32(0x9E3779B1)
ROW_SHIFT, ROW = np.uint32(30 - TABLE_BITS), np.uint32((1 << TABLE_BITS) - 1 << 2)
EMPTY = np.uint32(0xFFFFFFE0)  # of no id that can be, confidence 0
MISSED = np.array([[32], [33]], np.uint32)  # by order
GROWN = np.zeros(34, np.uint32)  # the next confidence by confidence, in the place of its order, or by MISSED
GROWN[[2, 4, 6, 32]] = 4, 6, 6, 2
GROWN[[8, 16, 24, 33]] = 16, 24, 24, 8


class BadBlock(ValueError):
    """A block whose bytes are not what was written."""


def _prior() -> np.ndarray:
    """Shares before anything came true, by context (order-2 confidence, order-1 confidence, agreement) and outcome."""
    k2, k1 = np.arange(CONTEXTS) >> 3, np.arange(CONTEXTS) >> 1 & 3
    return np.stack([3 * k2, 2 * k1, np.full(CONTEXTS, 4), np.full(CONTEXTS, 4)], axis=1).astype(np.int64)


class _Model:
    """The predictions of all lanes. Entries of the order-1 table are 32 * id + 2 * confidence, of the order-2 table 32 * id + 8 * confidence."""

    def __init__(self, lanes: int, bits: int):
        self.lanes, self.bits = lanes, bits
        self.last = np.full(4 * lanes << TABLE_BITS, EMPTY)  # in rows of four by the last id: order 1, and three of order 2
        self.base = np.arange(lanes, dtype=np.int64) << TABLE_BITS + 2
        self.counts = np.broadcast_to(_prior(), (lanes, CONTEXTS, OUTCOMES)).copy()
        self.history = 0
        self._mix(lanes)

    def _mix(self, active: int) -> None:
        counts = self.counts[:active]
        whole = (1 << SHARE_BITS) - int(LEAST_SHARES.sum())
        part = LEAST_SHARES + counts * whole // counts.sum(axis=2, keepdims=True)
        part[:, :, 3] += (1 << SHARE_BITS) - part.sum(axis=2)
        low = (part.cumsum(axis=2) - part).astype("<u2")
        self.low, self.share = low.ravel(), part.astype(np.uint16).ravel()
        self.lows = low.view("<u8").ravel()  # where outcomes 1, 2 and 3 begin, in the upper three fields of 16 bits

    def contexts(self, hashed: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
        """Places of order 1 and order 2, stacked in `out`, after two ids, the later of which times ONE is `hashed`; `before`: `_fork` of the earlier."""
        row = hashed >> ROW_SHIFT
        row &= ROW
        np.add(self.base[: hashed.shape[-1]], row, out=out[0])
        np.add(out[0], before, out=out[1])

    def renew(self, past: np.ndarray, outcomes: np.ndarray) -> None:
        """Take what came true (`outcomes`, since the last renewal, with lane and context) into the mix, and the frequencies of all ids so far (`past`: (lanes, ids), a power of two of them)."""
        active, t = past.shape
        seen = np.bincount(outcomes.ravel(), minlength=active * CONTEXTS * OUTCOMES)
        self.counts = self.counts[:active] + 4 * seen.reshape(active, CONTEXTS, OUTCOMES)
        self._mix(active)
        ids = np.sort(past, axis=1)
        new = np.ones((active, t), bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        starts = np.flatnonzero(new)
        self.run_id = ids.ravel()[starts].astype(np.int64)
        self.run_lane, self.run_start = starts >> t.bit_length() - 1, starts & t - 1
        self.run_length = np.diff(starts, append=active * t)
        self.history = t

    def slots(self) -> np.ndarray:
        """For each id, and then for each lane and place below `history`: id << 40 | start << 16 | frequency of the id alone, and of the run that holds the place."""
        packed = (self.run_id << 40 | self.run_start << 16 | self.run_length).astype(U) if self.history else np.zeros(0, U)
        alone = np.arange(1 << self.bits, dtype=U) * U(1 << 40 | 1 << 16) + U(1)
        return np.concatenate([alone, np.repeat(packed, self.run_length) if self.history else packed])


def _fork(hashed: np.ndarray) -> np.ndarray:
    """Which of a row's three entries of order 2 (1 to 3) is for an id times ONE, from bits that its own row does not use."""
    return np.maximum(hashed >> np.uint32(6) & np.uint32(3), np.uint32(1))


def _update(table: np.ndarray, at: np.ndarray, entry: np.ndarray, ids: np.ndarray) -> None:
    """Enter the ids that came (32 * id): confidence grows (to 3) where they were predicted and falls to 1 elsewhere."""
    changed = entry ^ ids  # where predicted, the confidence alone
    np.minimum(changed, MISSED, out=changed)
    table[at] = GROWN.take(changed, mode="clip") | ids


def _places(starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The places of runs of places."""
    ends = numbers.cumsum()
    return np.repeat(starts - (ends - numbers), numbers) + np.arange(ends[-1])


def _packed(words: np.ndarray) -> np.ndarray:
    """Seven bytes for each two words of a row: (rows, pairs, 7)."""
    words = np.pad(words, ((0, 0), (0, words.shape[1] % 2)))
    pairs = (words[:, ::2].astype(U) << WORD_BITS | words[:, 1::2]).astype(">u8")
    return np.ascontiguousarray(np.ascontiguousarray(pairs).view(np.uint8).reshape(*pairs.shape, 8)[:, :, 1:])


def _unpacked(body: np.ndarray) -> np.ndarray:
    pairs = np.zeros((len(body) // 7, 8), np.uint8)
    pairs[:, 1:] = body.reshape(-1, 7)
    whole = pairs.view(">u8")[:, 0].astype(U)
    return np.stack([whole >> WORD_BITS, whole & WORD], axis=1).ravel()


class BlockCoder:
    """encode(blocks of ids) to bytes and decode(bytes) to ids, in groups of at most `lanes` blocks."""

    def __init__(self, vocabulary: int, lanes: int = 1024):
        self.bits, self.lanes = max(1, (vocabulary - 1).bit_length()), lanes
        if self.bits > 22:
            raise ValueError("ids of over 22 bits")

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        return [b for at in range(0, len(blocks), self.lanes) for b in self._encode(blocks[at : at + self.lanes])]

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        return [b for at in range(0, len(blocks), self.lanes) for b in self._decode(blocks[at : at + self.lanes])]

    @staticmethod
    def _order(lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Lanes by falling length, and stretches (from, to, lanes still coded) between renewals and ends of lanes."""
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        cuts = {0, longest, *lengths.tolist(), *range(STRETCH, longest, STRETCH)}
        t = FIRST_RENEWAL
        while t < longest:
            cuts.add(t)
            t *= 2
        cuts = sorted(cuts)
        return order, [(a, b, int((lengths > a).sum())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @staticmethod
    def _renews(t: int) -> bool:
        return t >= FIRST_RENEWAL and t & (t - 1) == 0

    def _encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        lengths = np.array([len(b) for b in blocks])
        order, stretches = self._order(lengths)
        lanes, longest = len(blocks), int(lengths.max(initial=0))
        by_lane, sizes = np.zeros((lanes, longest), np.uint32), np.zeros(lanes, np.int64)
        for lane, k in enumerate(order):
            by_lane[lane, : lengths[k]] = blocks[k]
        if longest > MOST_IDS:
            raise ValueError(f"blocks have at most {MOST_IDS} ids")
        ids = np.zeros((longest + 2, lanes), np.uint32)  # after two ids that no block has
        ids[2:] = by_lane.T
        model = _Model(lanes, self.bits)
        outcomes = np.zeros((longest, lanes), np.int32)
        words, ptr = np.zeros((lanes, longest + 4), np.uint32), np.arange(lanes) * (longest + 4)
        flat, own = words.ravel(), ptr.copy()
        low, span = np.zeros(lanes, U), np.full(lanes, 1 << 56, U)
        placed = np.zeros((2, longest, lanes), np.uint16)  # start + 1 (0: not met) and frequency - 1 of each id among those at the last renewal
        renewed = 0
        for a, b, active in stretches:
            if self._renews(a):
                model.renew(by_lane[:active, :a], outcomes[renewed:a, :active])
                self._place(model, by_lane[:active, a : 2 * a], placed[:, a : 2 * a, :active])
                renewed = a
            x, lane = ids[a + 2 : b + 2, :active], np.arange(active)
            hashed = ids[a : b + 1, :active] * ONE
            at = np.empty((b - a, 2, active), np.int64)
            model.contexts(hashed[1:], _fork(hashed[:-1]), at.transpose(1, 0, 2))
            entry, shifted = np.empty(at.shape, np.uint32), x << np.uint32(5)
            for i in range(b - a):
                _update(model.last, at[i], model.last.take(at[i], out=entry[i], mode="clip"), shifted[i])
            differ = entry[:, 0] ^ entry[:, 1]
            met = placed[0, a:b, :active]
            outcome = np.where(met > 0, np.uint8(2), np.uint8(3))
            outcome[entry[:, 0] ^ shifted < 32] = 1
            outcome[entry[:, 1] ^ shifted < 32] = 0
            where = ((differ & np.uint32(31) | (differ < 32)) << np.uint32(2) | outcome) + lane * (CONTEXTS * OUTCOMES)
            outcomes[a:b, :active] = where
            start, share = model.low.take(where, mode="clip").astype(U), model.share.take(where, mode="clip").astype(U)
            by_frequency, escaped = outcome == 2, outcome == 3
            start0 = (met - by_frequency).astype(U) * by_frequency
            np.copyto(start0, x, where=escaped)
            share0 = (placed[1, a:b, :active] * by_frequency).astype(U) + U(1)
            shift0 = np.array([0, 0, max(0, model.history.bit_length() - 1), self.bits], U).take(outcome)
            low, span, ptr = low[:active].copy(), span[:active].copy(), ptr[:active].copy()
            given, gives = np.empty(x.shape, np.uint32), np.empty(x.shape, bool)
            for i in range(b - a):
                span >>= U(SHARE_BITS)
                low += span * start[i]
                span *= share[i]
                span >>= shift0[i]
                low += span * start0[i]
                span *= share0[i]
                small = np.less(span, LEAST, out=gives[i]).nonzero()[0]
                np.right_shift(low, WORD_BITS, out=given[i], casting="unsafe")
                low[small] = (low.take(small, mode="clip") & WORD) << WORD_BITS
                span[small] = span.take(small, mode="clip") << WORD_BITS
            number = gives.sum(axis=0)
            flat[_places(ptr, number)] = given.T[gives.T]
            ptr += number
            ended = slice(int((lengths[order] > b).sum()), active)  # lanes that end here give their last words
            for _ in range(2):
                flat[ptr[ended]] = low[ended] >> WORD_BITS
                low[ended] = (low[ended] & WORD) << WORD_BITS
                ptr[ended] += 1
            sizes[ended] = ptr[ended] - own[ended]
        words = words[:, : int(sizes.max(initial=0))]
        words[np.arange(words.shape[1])[None, :] >= sizes[:, None]] = 0
        while (carry := words >> np.uint32(28)).any():
            words &= np.uint32(WORD)
            words[:, :-1] += carry[:, 1:]
        packed = _packed(words)
        out: list[bytes] = [b""] * lanes
        for lane, k in enumerate(order):
            head = HEADER.pack(MAGIC, VERSION, self.bits, lengths[k], zlib.crc32(np.asarray(blocks[k], "<u4").tobytes()), 0)
            body = packed[lane, : -(-sizes[lane] // 2)].tobytes()
            out[k] = head[:-4] + struct.pack("<I", zlib.crc32(body, zlib.crc32(head[:-4]))) + body
        return out

    def _place(self, model: _Model, ids: np.ndarray, out: np.ndarray) -> None:
        """Start + 1 (0: not met) and frequency - 1 of `ids` (lanes, ids) in the model's history, to `out` (2, ids, lanes). A few lanes at a time, one after another: their tables stay in the cache."""
        some = max(1, (1 << 20) >> self.bits)
        runs = np.searchsorted(model.run_lane, np.arange(0, len(ids) + some, some))
        table = np.zeros(some << self.bits, np.uint32)  # start + 1, then frequency - 1 in the upper half
        packed = (model.run_length - 1 << 16 | model.run_start + 1).astype(np.uint32)
        for k in range(len(runs) - 1):
            mine, lanes = slice(runs[k], runs[k + 1]), slice(k * some, (k + 1) * some)
            key = model.run_lane[mine] - k * some << self.bits | model.run_id[mine]
            table[key] = packed[mine]
            x = ids[lanes].astype(np.int64)
            found = table.take(x + (np.arange(len(x))[:, None] << self.bits)).T
            out[0, :, lanes] = found & np.uint32(0xFFFF)
            out[1, :, lanes] = found >> np.uint32(16)
            table[key] = 0

    def _open(self, block: bytes) -> tuple[int, int, np.ndarray]:
        """(ids, their CRC, words) of a block, after its own checks."""
        if len(block) < HEADER.size:
            raise BadBlock("block is cut short")
        magic, version, bits, n, crc_ids, crc = HEADER.unpack_from(block)
        if magic != MAGIC or version != VERSION or bits != self.bits:
            raise BadBlock(f"not a block of this format and vocabulary: {magic!r}, version {version}, {bits} bits")
        if zlib.crc32(memoryview(block)[HEADER.size :], zlib.crc32(block[: HEADER.size - 4])) != crc:
            raise BadBlock("checksum of the block differs")
        return n, crc_ids, _unpacked(np.frombuffer(block, np.uint8, offset=HEADER.size))

    def _decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        opened = [self._open(b) for b in blocks]
        lengths = np.array([n for n, _, _ in opened])
        order, stretches = self._order(lengths)
        lanes, longest = len(blocks), int(lengths.max(initial=0))
        words = np.zeros((lanes, max((len(w) for _, _, w in opened), default=0) + 4), np.uint32)
        for lane, k in enumerate(order):
            words[lane, : len(opened[k][2])] = opened[k][2]
        code, ptr, flat = words[:, 0].astype(U) << WORD_BITS | words[:, 1], np.arange(lanes) * words.shape[1] + 1, words.ravel()
        span = np.full(lanes, 1 << 56, U)
        model = _Model(lanes, self.bits)
        ids, outcomes = np.zeros((longest, lanes), np.uint32), np.zeros((longest, lanes), np.int32)
        none = np.zeros(lanes, np.uint32)
        slots, renewed = model.slots(), 0
        fields, tops = U(1 << 16 | 1 << 32 | 1 << 48), U(1 << 31 | 1 << 47 | 1 << 63)
        for a, b, active in stretches:
            if self._renews(a):
                model.renew(np.ascontiguousarray(ids[:a, :active].T), outcomes[renewed:a, :active])
                slots, renewed = model.slots(), a
            lane = np.arange(active)
            by_context, by_outcome = lane * CONTEXTS, lane * OUTCOMES
            tables = np.zeros((active, OUTCOMES), np.int64)  # of the slots: outcome 2 has the lane's, others the ids alone
            tables[:, 2] = (1 << self.bits) + lane * model.history
            tables = tables.ravel()
            shifts, predictor = np.array([0, 0, max(0, model.history.bit_length() - 1), self.bits], U), np.array([active, 0])
            code, span, ptr = code[:active].copy(), span[:active].copy(), ptr[:active].copy()
            one, fork = (ids[a - 1, :active] if a else none[:active]) * ONE, _fork((ids[a - 2, :active] if a > 1 else none[:active]) * ONE)
            at, entry = np.empty((2, active), np.int64), np.empty((2, active), np.uint32)
            for t in range(a, b):
                model.contexts(one, fork, at)
                model.last.take(at, out=entry, mode="clip")
                context = entry[0] ^ entry[1]
                agree = context < 32
                context &= np.uint32(31)
                context |= agree
                place = by_context + context
                span >>= U(SHARE_BITS)
                ends = code // span
                ends *= fields
                ends |= tops
                ends -= model.lows.take(place, mode="clip")  # the top bit of a field is left where the code is not below that outcome
                ends &= tops
                outcome = np.bitwise_count(ends).astype(np.int64)
                place *= OUTCOMES
                place += outcome
                outcomes[t, :active] = place
                code -= span * model.low.take(place, mode="clip")
                span *= model.share.take(place, mode="clip")
                span >>= shifts.take(outcome, mode="clip")
                v = code // span
                place = tables.take(by_outcome + outcome, mode="clip")
                place += v.view(np.int64)
                slot = slots.take(place, mode="clip")
                code -= span * (slot >> U(16) & U(0xFFFFFF))
                span *= slot & U(0xFFFF)
                slot >>= U(40)
                now = slot.astype(np.uint32)
                guessed = (outcome < 2).nonzero()[0]
                now[guessed] = entry.ravel().take(guessed + predictor.take(outcome.take(guessed)), mode="clip") >> np.uint32(5)
                ids[t, :active] = now
                small = (span < LEAST).nonzero()[0]
                came, read = code.take(small, mode="clip"), ptr.take(small, mode="clip")
                read += 1
                came <<= WORD_BITS
                came |= flat.take(read, mode="clip")
                code[small], ptr[small] = came, read
                span[small] = span.take(small, mode="clip") << WORD_BITS
                fork, one = _fork(one), now * ONE
                now <<= np.uint32(5)
                _update(model.last, at, entry, now)
        by_lane = np.ascontiguousarray(ids.T)
        out: list[np.ndarray] = [by_lane[:0]] * lanes
        for lane, k in enumerate(order):
            out[k] = by_lane[lane, : lengths[k]]
            if zlib.crc32(out[k].astype("<u4").tobytes()) != opened[k][1]:
                raise BadBlock("checksum of the ids differs")
        return out
