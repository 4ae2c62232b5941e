"""Vectorised word splitting and hashing over Arrow string columns; used inside tasks by several operators.

A word is a run of characters other than space and U+0009..U+000D. All six are single bytes in UTF-8, so that splitting
bytes equals splitting characters. Hashes are 64-bit polynomials over bytes (then mixed), the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE, _M64 = 0x9E3779B97F4A7C15 | 1, 1 << 64
_INVERSE = pow(_BASE, -1, _M64)
#: Text bytes that one vectorised step takes at a time (a longer text is taken alone, whole).
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of the public splitmix64 generator)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), _M64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each of the sorted, disjoint spans [start, end) of ``raw``."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > PIECE:  # one long span, summed in steps
            steps = range(lo, hi, PIECE)
            sums = np.array([np.sum(_BYTE_VALUE[raw[at : min(hi, at + PIECE)]] * powers(_BASE, min(hi - at, PIECE))) for at in steps], np.uint64)
            scales = np.array([pow(_BASE, at - lo, _M64) for at in steps], np.uint64)
            out[i:j] = mix(np.sum(sums * scales, keepdims=True) + np.uint64(hi - lo))
            i = j
            continue
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw[lo:hi]] * powers(_BASE, hi - lo), out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * powers(_INVERSE, hi - lo + 1)[a] + (b - a).astype(np.uint64))
        i = j
    return out


class Words:
    """The words of some texts: byte ``starts`` and ``ends`` in ``raw``, their ``hashes``, and ``first``: n + 1 word offsets of the texts."""

    def __init__(self, column: pa.Array, lower: bool = False, hashed: bool = True):
        self.raw, self.offsets = bytes_of(column)
        if lower:
            self.raw = LOWER[self.raw]
        n = len(self.raw)
        word = ~SPACE[self.raw]
        cut = np.zeros(n + 1, bool)  # a text begins here
        cut[self.offsets] = True
        begins, finishes = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | cut[1:n]
        finishes[:-1] &= ~word[1:] | cut[1:n]
        self.word, self.starts, self.ends = word, np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = span_hashes(self.raw, self.starts, self.ends) if hashed else None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ascending ``offsets``, of which the last is the end; counted in steps."""
    before, total = np.zeros(len(offsets), np.int64), 0
    for lo in range(0, len(flags), PIECE):
        block = np.cumsum(flags[lo : lo + PIECE], dtype=np.int64)
        i, j = np.searchsorted(offsets, [lo + 1, lo + len(block) + 1])
        before[i:j] = total + block[offsets[i:j] - lo - 1]
        total += int(block[-1])
    return np.diff(before)


def windows(hashes: np.ndarray, first: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay in their text, and the index of each one's first word; taken in steps."""
    keys, places, step = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], max(k, PIECE // 4)
    inverse = pow(base, -1, _M64)
    for lo in range(0, len(hashes) - k + 1, step):
        part = hashes[lo : lo + step + k - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        begin = np.arange(lo, lo + len(part) - k + 1)
        at = np.flatnonzero(begin + k <= first[np.searchsorted(first, begin, "right")])
        keys.append(mix((total[at + k] - total[at]) * powers(inverse, len(part))[at]))
        places.append(begin[at])
    return np.concatenate(keys), np.concatenate(places)


def with_body(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """A batch whose first column is a struct, with that struct's string field ``name`` as one more column ("text"); nothing is copied."""
    at = batch.schema.field(0).type.get_field_index(name)
    return pa.RecordBatch.from_arrays([*batch.columns, batch.column(0).flatten()[at]], [*batch.schema.names, "text"])


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE // 2) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose texts hold about ``limit`` bytes; a longer text comes alone."""
    at = batch.schema.get_field_index(column)
    _, offsets = bytes_of(batch.column(at))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def parts(text: pa.Array, limit: int = PIECE) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Strings of about ``limit`` bytes together, in order, and the row of ``text`` that each is of.

    A longer text is cut behind white space, so that no word is cut; its strings come one after another, and only a word of more
    than ``limit`` bytes makes a longer step. Nothing is copied. Null counts as empty.
    """
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    raw, offsets = bytes_of(text)
    if not len(text):
        return
    cuts, owners = [offsets[:-1]], [np.arange(len(text))]
    for row in np.flatnonzero(np.diff(offsets) > limit):
        at, end, found = int(offsets[row]), int(offsets[row + 1]), []
        while end - at > limit:
            space = np.flatnonzero(SPACE[raw[at : at + limit]])
            if len(space):
                at += int(space[-1]) + 1
            else:  # the next white space, looked for step by step
                at += limit
                while at < end and not SPACE[raw[at]]:
                    ahead = np.flatnonzero(SPACE[raw[at : min(end, at + limit)]])
                    at = at + int(ahead[0]) if len(ahead) else min(end, at + limit)
                at = min(end, at + 1)
            if at < end:
                found.append(at)
        cuts.append(np.array(found, np.int64))
        owners.append(np.full(len(found), row))
    begin, owner = np.concatenate(cuts), np.concatenate(owners)
    order = np.lexsort((begin, owner))
    bounds, owner = np.append(begin[order], offsets[-1]), owner[order]
    i, n = 0, len(owner)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        at = np.ascontiguousarray(bounds[i : j + 1] - bounds[i])
        data = pa.py_buffer(raw[bounds[i] : bounds[j]])
        yield pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at), data), owner[i:j]
        i = j


def give_back() -> None:
    """Return memory that was freed in this process to the system; else allocators keep it while other processes of the machine need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with :func:`give_back` at the end of each partition: Spark keeps idle Python workers for later tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped
