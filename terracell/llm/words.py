"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_table = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)


def _coefficients(n: int) -> np.ndarray:
    global _table
    if n > len(_table):
        _table = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    return _table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, begins: np.ndarray, breaks: np.ndarray = _SPACE):
    """(hash, first byte, end byte) of each word, and the words before each text.

    A word is a run of bytes outside ``breaks`` (space and 09 to 0D), A-Z lower-cased.
    """
    n_texts = len(begins) - 1
    solid = ~breaks[data]
    at = np.flatnonzero(solid)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(n_texts + 1, np.int64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1] + 1
    edge = begins[:-1]
    edge = edge[edge < len(data)]
    first[np.searchsorted(at, edge[solid[edge]])] = True
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lens)
    value = _LOWER[data[at]] * _coefficients(int(lens.max()))[place]
    hashes = mix(np.add.reduceat(value, starts) + lens.astype(np.uint64) * _STEP)
    begin = at[starts]
    return hashes, begin, begin + lens, np.searchsorted(begin, begins)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text; of the whole text when it has fewer."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : n - size + 1 + i]
    return mix(total)


def shingle_sets(texts: pa.Array, k: int = 5):
    """The sorted distinct shingle hashes of each text, one array at a time."""
    data, begins = text_bytes(texts)
    words, _, _, before = word_hashes(data, begins)
    for a, b in zip(before[:-1], before[1:]):
        yield np.unique(shingle_hashes(words[a:b], k))


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes of text each; one text is never cut."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
