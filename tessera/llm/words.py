"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow column at once.

A word is a maximal run of characters outside ``\\x20\\x09-\\x0D``. The hash of a byte span is
``sum(T[b_j] * B**j)`` modulo 2**64 with a fixed random table ``T`` and an odd ``B``, read off one
prefix sum per segment, then mixed. Texts longer than ``SEGMENT`` bytes are cut at white space into
segments, so memory follows the segment and not the text; only a single longer word stretches one.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[0x41:0x5B] = _TABLE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * SEGMENT:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Lists of (document, start, end) of about SEGMENT bytes together; cuts are at white space."""
    group, held = [], 0
    for k in range(len(offsets) - 1):
        at, end = int(offsets[k]), int(offsets[k + 1])
        while end - at > SEGMENT:
            cut = at + SEGMENT
            spaces = np.flatnonzero(IS_SPACE[data[at:cut]])
            if len(spaces) and spaces[-1]:
                cut = at + int(spaces[-1])
            else:
                while cut < end and not IS_SPACE[data[cut]]:
                    cut += 1
            if group:
                yield group
            yield [(k, at, cut)]
            group, held, at = [], 0, cut
        if held + end - at > SEGMENT and group:
            yield group
            group, held = [], 0
        group.append((k, at, end))
        held += end - at
    if group:
        yield group


@dataclass
class Words:
    """Words of a batch in document order: their hashes, and how many each document has."""

    hashes: np.ndarray
    counts: np.ndarray
    chars: np.ndarray | None = None
    marks: np.ndarray | None = None

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def split_words(texts: pa.Array, *, fold: bool, classes: tuple[bytes, ...] | None = None) -> Words:
    """Word hashes of every text. fold: A-Z count as a-z. classes: also count code points in words, and the bytes of each class."""
    return split_buffers(*text_buffers(texts), fold=fold, classes=classes)


def split_buffers(data: np.ndarray, offsets: np.ndarray, *, fold: bool, classes: tuple[bytes, ...] | None = None) -> Words:
    """As ``split_words``, of the stretches between offsets."""
    n = len(offsets) - 1
    table = _FOLDED if fold else _TABLE
    counts = np.zeros(n, np.int64)
    chars = np.zeros(n, np.int64) if classes is not None else None
    marks = np.zeros((len(classes or ()), n), np.int64)
    members = [np.isin(_BYTES, np.frombuffer(c, np.uint8)) for c in classes or ()]
    hashes: list[np.ndarray] = []
    for group in _segments(data, offsets):
        lo, hi = group[0][1], group[-1][2]
        if hi <= lo:
            continue
        part = data[lo:hi]
        docs = np.array([g[0] for g in group])
        starts_of = np.array([g[1] - lo for g in group])
        space = IS_SPACE[part]
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, space[:-1]
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, space[1:]
        cuts = starts_of[starts_of < len(part)]
        before[cuts] = True
        after[cuts[cuts > 0] - 1] = True
        word = ~space
        starts = np.flatnonzero(word & before)
        ends = np.flatnonzero(word & after) + 1
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[part] * _power(_BASE, len(part))[: len(part)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * _power(_INVERSE, len(part))[starts]))
        bounds = np.searchsorted(starts, np.append(starts_of, len(part)))
        np.add.at(counts, docs, np.diff(bounds))
        if classes is not None:
            flags = [word & ((part & 0xC0) != 0x80), *(m[part] for m in members)]
            for out, flag in zip([chars, *marks], flags, strict=True):
                run = np.concatenate([[0], np.cumsum(flag)])
                np.add.at(out, docs, np.diff(run[np.append(starts_of, len(part))]))
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts, chars, marks)


_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], np.uint64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within documents, and their number per document (no run where too few words)."""
    h, counts = words.hashes, np.maximum(words.counts - size + 1, 0)
    if len(h) < size:
        return np.zeros(0, np.uint64), counts
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * _FACTORS[k]
    doc = words.documents
    return mix(out[doc[: len(out)] == doc[size - 1 :]]), counts


def release() -> None:
    """Give memory that is free in this worker back to the machine; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batches(rows, budget: int, column: str):
    """Arrow batches cut so that the texts of each piece stay near ``budget`` bytes."""
    for batch in rows:
        release()
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // budget, prepend=0)) if len(lengths) else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)
    release()
