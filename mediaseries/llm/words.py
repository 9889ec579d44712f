"""Texts as bytes and words in numpy, shared by the operators that run on Arrow batches.

A word is a run of ASCII digits, letters and bytes from 0x80 up; A-Z count as a-z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Each byte as it counts in a word: A-Z lower-cased, a blank for whatever separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOLD_ARRAY = np.frombuffer(FOLD, np.uint8)
#: The same class of characters as a regular expression of Java, Python and RE2, once A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CHUNK_BYTES = 1 << 20
_POWERS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and the last ends; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """The allocators give back what they hold: workers wait for their next task with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in smaller runs of rows, so that what is derived from one stays small beside it.

    At the end of a task the allocators give back what they hold.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
    give_back()


def chunks(data: np.ndarray, at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first text, text behind the last, bytes, offsets."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def pack(records: np.ndarray) -> bytes:
    """Records field by field, compressed."""
    data = b"".join(np.ascontiguousarray(records[name]).tobytes() for name in records.dtype.names)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(packed: bytes, kind: np.dtype) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    data, at = pa.decompress(packed[8:], size, codec="zstd", asbytes=True), 0
    out = np.empty(size // kind.itemsize, kind)
    for name in kind.names:
        width = kind[name].itemsize * len(out)
        out[name] = np.frombuffer(data[at : at + width], kind[name])
        at += width
    return out


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and where each text's words begin and the last end."""
    folded = FOLD_ARRAY[data]
    inside = folded != 32
    begins, n = inside.copy(), len(data)
    begins[1:] &= ~inside[:-1]
    edges = at[:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    held = np.flatnonzero(inside)
    first = np.searchsorted(held, starts)
    lengths = np.diff(np.append(first, len(held)))
    place = np.arange(len(held)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(min(_POWERS, int(lengths.max())), _BASE, np.uint64))
    values = (folded[held].astype(np.uint64) + np.uint64(1)) * powers[place % _POWERS]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), counts


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``size`` words within a text; a text of fewer words, but not none, is one run.

    Returns the hashes and where each text's runs begin and the last end.
    """
    n = np.diff(at)
    runs = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    first = np.repeat(at[:-1], runs) + np.arange(out[-1]) - np.repeat(out[:-1], runs)
    last = np.repeat(at[1:], runs)
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        there = first + k < last
        word = np.where(there, words[np.minimum(first + k, len(words) - 1)], np.uint64(k + 1))
        total = mix(total * _BASE + word)
    return total, out
