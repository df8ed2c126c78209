"""Whole-batch word splitting and hashing on Arrow text buffers.

Texts are read straight from the Arrow data buffer as bytes: no Python string
is made for a word.  Both word classes of the queries are byte classes, so
UTF-8 needs no decoding (bytes of 0x80 and above are always word bytes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U64 = np.uint64
#: Words of more bytes are hashed by xxhash, one by one.
_LONG = 64


def _class(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Fixed by the query contracts: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z became a-z).
SPACED = _class([0x20, *range(0x09, 0x0E)])
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (xor-shift-multiply); a bijection."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(31)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(29)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(32)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4_000_000):
    """Runs (i, j) of documents of about `most` bytes together; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each document and the total)."""
    low = LOWER[buf]
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[low]
    first = np.empty(len(low), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = offsets[:-1][offsets[:-1] < len(low)]
    first[edges] = True
    first &= inside
    last = np.empty(len(low), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[edges[edges > 0] - 1] = True
    last &= inside
    starts = np.flatnonzero(first)
    return low, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: its length, then eight bytes a round are mixed in; of
    words of more than _LONG bytes xxhash's."""
    sizes = (ends - starts).astype(np.int64)
    out = mix(sizes.astype(_U64) + _U64((0xD6E8FEB86659FD93 * (seed + 1)) & (1 << 64) - 1))
    if not len(starts):
        return out
    data = np.concatenate([low, np.zeros(8, np.uint8)]).tobytes()
    eights = np.ndarray((len(low) + 1,), "<u8", data, 0, (1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    done = 0
    while live.size:
        chunk = eights[starts[live] + done]
        left = sizes[live] - done
        part = left < 8
        chunk[part] &= (_U64(1) << (left[part].astype(_U64) * _U64(8))) - _U64(1)
        out[live] = mix(out[live] * _U64(0x9E3779B97F4A7C15) + chunk)
        done += 8
        live = live[left > 8]
    view = memoryview(data)
    for k in np.flatnonzero(sizes > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(view[starts[k] : ends[k]], seed)
    return out


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each document and the total): every run of `width` words; of a
    shorter document with words, its whole sequence; of one without, nothing."""
    counts = np.diff(first)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(int(at[-1]), _U64)
    if not len(out):
        return out, at
    factors = mix(np.arange(1, width + 1, dtype=_U64) * _U64(0xA0761D6478BD642F)) | _U64(1)
    full = np.flatnonzero(counts >= width)
    if len(full):
        n = len(words) - width + 1
        rolled = np.zeros(n, _U64)
        for k in range(width):
            rolled += words[k : k + n] * factors[k]
        rows = np.repeat(first[:-1][full] - at[:-1][full], many[full]) + _ranges(at[:-1][full], many[full])
        out[_ranges(at[:-1][full], many[full])] = rolled[rows]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[first[d] : first[d + 1]]
        out[at[d]] = np.append(w * factors[: len(w)], _U64(0x632BE59BD9B4E019 * len(w) & (1 << 64) - 1)).sum(dtype=_U64)
    return mix(out), at


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... count times, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    keep = counts > 0
    starts, counts, heads = starts[keep], counts[keep], heads[keep]
    step[heads[0]] = starts[0]
    step[heads[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


ranges = _ranges
