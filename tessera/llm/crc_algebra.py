"""CRC-32 of concatenations from the CRCs and lengths of their pieces.

Appending n zero bytes to a message multiplies its CRC register by a 32 x 32 matrix over GF(2) that depends on n alone, so
crc(a + b) = shift(crc(a), len(b)) xor crc(b). The matrix of n is the product of matrices of powers of two; each is held
as four tables of 256 values, one for each byte of the register. All work is on NumPy arrays.
"""

from __future__ import annotations

from functools import cache

import numpy as np

__all__ = ["combine", "runs", "shift"]

#: The reflected CRC-32 polynomial. A fixed value.
POLYNOMIAL = 0xEDB88320


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Matrix (32 columns as uint32) times each of `values`."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@cache
def _matrix(power: int) -> np.ndarray:
    """The columns of the matrix for 2**power zero bytes."""
    if power:
        half = _matrix(power - 1)
        return _times(half, half)
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = columns >> np.uint32(1) ^ np.where(columns & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return columns


@cache
def _tables(power: int) -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(_matrix(power), values << np.uint32(8 * k)) for k in range(4)])


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The linear part of each CRC after as many zero bytes as `lengths` says."""
    out, lengths = np.array(crcs, np.uint32), np.asarray(lengths, np.int64)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> power & 1)
        if len(at):
            t, x = _tables(power), out[at]
            out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


def combine(left: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
    """crc(a + b) from crc(a), crc(b) and len(b)."""
    return shift(left, right_lengths) ^ np.asarray(right, np.uint32)


def runs(crcs: np.ndarray, lengths: np.ndarray, texts: np.ndarray, joiner: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, crc) of every run of `least` to `most` consecutive words of one text, joined by one byte whose CRC is `joiner`.

    `crcs`, `lengths` and `texts` are by word, in order; the runs of n words come from those of n - 1.
    """
    crcs, lengths = np.asarray(crcs, np.uint32), np.asarray(lengths, np.int64)
    led = combine(np.full(len(crcs), joiner, np.uint32), crcs, lengths) if most > 1 else crcs  # the word with the joiner before it
    found_texts, found = [], []
    now, starts = crcs, np.arange(len(crcs))
    for n in range(1, most + 1):
        if n > 1:
            inside = starts[:-1][texts[starts[:-1]] == texts[np.minimum(starts[:-1] + n - 1, len(crcs) - 1)]] if len(starts) else starts
            inside = inside[inside + n - 1 < len(crcs)]
            keep = np.searchsorted(starts, inside)
            end = inside + n - 1
            now, starts = combine(now[keep], led[end], lengths[end] + 1), inside
        if n >= least:
            found_texts.append(texts[starts])
            found.append(now)
    return np.concatenate(found_texts), np.concatenate(found)
