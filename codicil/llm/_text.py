"""Vectorised text kernels for Arrow batches: word bounds, word hashes, shingle sets, SuperMinHash."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=_U)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def chunks(column):
    """Cut a string column into (first row, bytes, offsets) of about CHUNK_BYTES; null is like empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a chunk, and each text's first word (with the end)."""
    solid = ~_SEPARATOR[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    final = solid.copy()
    final[:-1] &= ~solid[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[bounds] = solid[bounds]
    final[bounds - 1] = solid[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if ``lower``."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    left = ends - starts
    out = mix(left.astype(_U) + _U(0x9E3779B97F4A7C15))
    long = np.flatnonzero(left > LONG_WORD)
    # All words have a first step; only those of more than eight bytes are picked out for more.
    out = mix(out * _U(3) ^ (eight[starts] & _KEEP[np.minimum(left, 8)]))
    rows = np.flatnonzero((left > 8) & (left <= LONG_WORD))
    at, left = starts[rows] + 8, left[rows] - 8
    while len(rows):
        out[rows] = mix(out[rows] * _U(3) ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        at, left = at + 8, left - 8
        go = left > 0
        rows, at, left = rows[go], at[go], left[go]
    for i in long:
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def shingle_sets(column, width: int):
    """For each row its sorted distinct hashes of ``width`` consecutive words.

    Fewer words make one shingle of the whole sequence; no word, none.
    """
    for _, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        rolled = h
        for _ in range(width - 1):
            rolled = mix(rolled[:-1] * _U(0x9E3779B97F4A7C15) + h[len(h) - len(rolled) + 1 :]) if len(rolled) > 1 else rolled[:0]
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                x = np.array([b - a], dtype=_U)
                for i in range(a, b):
                    x = mix(x * _U(5) + h[i : i + 1])
                yield x
            else:
                yield np.zeros(0, dtype=_U)


def super_minhash(sets: list[np.ndarray], m: int, seed: int = 0) -> np.ndarray:
    """SuperMinHash signatures of hash sets, one row of ``m`` values for each set.

    Each element goes through its own random permutation of the m registers; at its
    j-th step it offers j + u, u in [0, 1), to the register the permutation names.
    After step j no later offer can be below j + 1, so a set whose registers are all
    below j + 1 stops.  All sets step together; the j-th entry of a permutation comes
    from the trail of its earlier swaps.  Values hold j in the upper and u in the
    lower 40 bits.  Registers of an empty set stay at the largest value.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=_U)
    flat, rows = out.reshape(-1), np.repeat(np.arange(len(sets)), sizes)
    element = mix(np.concatenate([*sets, np.zeros(0, _U)]) + _U(seed * 2 + 1))
    trail: list[np.ndarray] = []
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = (j + (draw >> _U(40)) % _U(m - j)).astype(np.int64)
        place = swap
        for i in range(j - 1, -1, -1):
            place = np.where(trail[i] == place, i, place)
        np.minimum.at(flat, rows * m + place, (_U(j) << _U(40)) | (draw & _U((1 << 40) - 1)))
        trail.append(swap)
        live = np.unique(rows)
        open_ = np.zeros(len(sets), dtype=bool)
        open_[live] = out[live].max(axis=1) >= _U((j + 1) << 40)
        go = open_[rows]
        if not go.all():
            rows, element, trail = rows[go], element[go], [t[go] for t in trail]
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each row and band of the signatures."""
    n, m = signatures.shape
    parts = signatures.reshape(n, bands, m // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (n, bands)).copy()
    for i in range(m // bands):
        key = mix(key * _U(3) ^ parts[:, :, i])
    return key.view(np.int64)
