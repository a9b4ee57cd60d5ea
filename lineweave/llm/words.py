"""Words and word n-grams of many texts at once, as 64-bit hashes, with numpy.

A word is a run of ASCII digits and small letters and of characters beyond ASCII; all else, white space and punctuation, only
parts words. On request Unicode spaces and punctuation part words too, and each character of a script written without
spaces is a word. The texts of a batch are laid end to end with line feeds
between them, so one pass over the bytes serves all of them; batches are cut to half a megabyte first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SLICE_BYTES = 1 << 19
_U = np.uint64


def _mixer(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = _mixer(11, 256)
_STEP = _mixer(12, 1)[0]
_GRAM = _mixer(13, 64)
_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[97:123] = _PARTS[128:] = False


#: Thai, Lao, Burmese, Khmer, Japanese and Chinese: first and last code points.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Spaces and punctuation beyond ASCII.
PUNCTUATION = ((0xA0, 0xA1), (0xAB, 0xAB), (0xB7, 0xB7), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x3003), (0x3008, 0x301F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF5B, 0xFF65))


def char_class(ranges: Sequence[tuple[int, int]]) -> str:
    """The inside of a character class, as Spark's and DuckDB's patterns write it."""
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def rows_at_once(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in smaller ones, so that few texts are Python strings at any time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def slices(texts: Sequence[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes each; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _within(points: np.ndarray, ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    first, last = np.array(ranges).T
    at = np.searchsorted(first, points, "right") - 1
    return (at >= 0) & (points <= last[at])


def _beyond_ascii(buf: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Mark the bytes of Unicode punctuation in ``parts``; where words begin or end without a byte between."""
    edge = np.zeros(len(buf), bool)
    lead = np.flatnonzero((buf == 0xC2) | (buf >= 0xE0))
    for size, mask, own in ((2, 0x1F, buf[lead] < 0xE0), (3, 0x0F, (buf[lead] >= 0xE0) & (buf[lead] < 0xF0)), (4, 0x07, buf[lead] >= 0xF0)):
        at = lead[own]
        points = (buf[at] & mask).astype(np.int64)
        for k in range(1, size):
            points = (points << 6) | (buf[at + k] & 0x3F)
        for k in range(size):
            parts[at[_within(points, PUNCTUATION)] + k] = True
        alone = at[_within(points, UNSPACED)]
        edge[alone] = edge[alone + size] = True
    return edge


def split_words(texts: Sequence[bytes], scripts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, ends, text of each word)`` of the joined texts, which are UTF-8; ``scripts``: see above."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    parts = _PARTS[buf]
    edge = _beyond_ascii(buf, parts) if scripts else np.zeros(1, bool)
    before = np.empty_like(parts)
    before[0], before[1:] = True, parts[:-1]
    starts, ends = np.flatnonzero(~parts & (before | edge)), np.flatnonzero(~before & (parts | edge))
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    return buf, starts, ends, np.searchsorted(first, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    total = np.concatenate([[0], np.cumsum(length)])
    inside = np.arange(total[-1]) - np.repeat(total[:-1], length)
    power = np.ones(int(length.max()), np.uint64)
    power[1:] = _STEP
    power = np.cumprod(power, dtype=np.uint64)
    values = _BYTE[buf[inside + np.repeat(starts, length)]] * power[inside]
    return mix(np.add.reduceat(values, total[:-1]) + length.astype(np.uint64))


def gram_hashes(texts: Sequence[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: the n-grams of words of each text in order, and how many each text has.

    A text of fewer than n words, but at least one, has a single gram of all its words."""
    buf, starts, ends, owner = split_words(texts, scripts=True)
    h = word_hashes(buf, starts, ends)
    words = np.bincount(owner, minlength=len(texts))
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    if not len(h):
        return np.empty(0, np.uint64), counts
    first = np.cumsum(words) - words
    lead = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    span = np.repeat(np.minimum(words, n), counts)
    out = span.astype(np.uint64)
    for k in range(n):
        out = out + np.where(k < span, h[np.minimum(lead + k, len(h) - 1)] * _GRAM[k], _U(0))
    return mix(out), counts
