"""Texts of Arrow batches as arrays of word and shingle hashes.

A batch is cut into pieces of a few MB, so that the arrays stay small whatever Spark puts
into a batch. A null text counts as empty. Hashes have 64 bits and depend on the words only,
so any two tasks agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose arrays are held at once; a longer text is taken whole.
PIECE_BYTES = 1 << 21
SHINGLE_WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the public splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random odd 64-bit numbers, the same in every process."""
    steps = np.arange(1 + (seed << 20), n + 1 + (seed << 20), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps) | np.uint64(1)


def _table(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Bytes of words as the contracts say: everything but space and \x09-\x0D.
SPACED = _table(b" \t\n\x0b\x0c\r")
#: Letters and digits of ASCII and all bytes of longer characters; punctuation separates.
PLAIN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
_BYTE = constants(256, 1)[_FOLD]
_STEP = int(constants(1, 2)[0])
_BACK = pow(_STEP, -1, 1 << 64)
_PLACES = constants(64, 3)
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64, grown when needed."""
    if _powers["n"] < n:
        size = max(n, PIECE_BYTES + 4096)
        for name, base in (("up", _STEP), ("down", _BACK)):
            out, have = np.ones(size, dtype=np.uint64), 1
            while have < size:
                more = min(have, size - have)
                out[have:have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _powers[name] = out
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row (exclusive), UTF-8 bytes and row offsets of each piece of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, index, data = column.buffers()
    at = np.frombuffer(index, dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE_BYTES, side="right")) - 1)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one more entry than rows)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = inside[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    edge[offsets] = True
    marks = np.flatnonzero(edge)
    keep = word[marks[:-1]]
    starts, ends = marks[:-1][keep], marks[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case, from one running sum over the bytes."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the first shingle of each row.

    A row with fewer words than a shingle has its whole sequence as one, a row without words none.
    """
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    sizes = np.where(short, 1, full)
    at = np.concatenate(([0], np.cumsum(sizes)))
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            rolled += words[k:len(words) - size + 1 + k] * _PLACES[k]
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    out = np.empty(at[-1], dtype=np.uint64)
    rows = np.repeat(np.arange(len(counts)), full)
    place = np.arange(len(rows)) - np.repeat(np.concatenate(([0], np.cumsum(full)))[:-1], full)
    target = at[rows] + place
    out[target] = mix(rolled[first[rows] + place])
    for row in np.flatnonzero(short):
        own = words[first[row]:first[row + 1]]
        out[at[row]] = mix(np.append(own * _PLACES[:len(own)], _PLACES[8 + len(own)]).sum(keepdims=True))[0]
    return out, at


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text."""
    for lo, _hi, data, offsets in pieces(column):
        starts, ends, first = word_bounds(data, offsets, SPACED)
        shingles, at = shingle_hashes(word_hashes(data, starts, ends), first)
        for i in range(len(offsets) - 1):
            yield lo + i, np.unique(shingles[at[i]:at[i + 1]])


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the slices one after the other (A-Z in lower case, if asked), and where each begins (one more entry)."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    raw = data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]
    return (_FOLD.astype(np.uint8)[raw] if fold else raw), at


def strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """A text column from bytes and offsets."""
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()),
                                                            pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
