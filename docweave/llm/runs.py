"""Periodic runs of words, by a suffix automaton with link-cut access.

The suffixes of a prefix are a path of the automaton's suffix-link tree, from the prefix's state to the root. A link-cut tree keeps, for
each of its preferred paths, where the words of these states ended last. Appending word r accesses the path of prefix r: each segment on it
has one last end e and covers the lengths (low, high]; with d = r - e and low < d <= high, the last d words also end at e, that is, a
square of period d ends at r, and d is its smallest period. The segments are then recoloured to r. A square is extended to both sides as
far as words d apart are equal, which gives the run.

The wanted runs repeat a period at least four times, so the automaton only reads where one can be. For each level m = 1, 2, 4, ... the m-word
windows that occurred less than 2m words before are marked; a run of a period q in [m, 2m) marks over 2m windows in a row, and of any q of
these at least one did not occur less than q words before (a cycle of q words has over m different windows of m words, hence one
that it has once). Only stretches of that many marks, with two or more such ones, are read, and of these what is near such ones, in blocks of 8m words that step by 4m (a run's first two periods are in one of them), or from 4m
before the end of the last run found (two runs of a level share less than 4m words). Windows are compared by 64-bit hashes, and so are words.

Defined cases: null, empty and wordless texts have no runs, four nulls and the hashes of nothing; a text of under six words has no
run; a null id changes no text (see ``spun``); repeated rows give equal rows; an empty table gives an empty result; extra columns are left alone.
Batches are taken in steps of about 512 KB; a longer text is taken alone. Its words take about 150 bytes each while windows are marked; a
block of the automaton takes about 500 bytes a word, and has at most twice the words of the longest period that may be found there four times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import unpacked
from .words import Words, mix, pieces

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Lengths and suffix links of the states (state 0 is no state, 1 the root), and the state of each prefix."""
    length, link, to, ends, last = [0, 0], [0, 0], [{}, {}], [], 1
    for n, c in enumerate(words, 1):
        new, p = len(length), last
        length.append(n)
        link.append(1)
        to.append({})
        while p and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(to[q].copy())
                while p and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        ends.append(new)
        last = new
    return length, link, ends


class LinkCut:
    """Preferred paths of a rooted tree as splay trees, each with one colour (kept at the splay tree's root)."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = list(parent)  # splay parent, or for a splay root the path's parent in the tree
        self.up[1] = 0
        self.less, self.more, self.colour = [0] * n, [0] * n, [0] * n  # less: nearer the root

    def splay(self, x: int) -> None:
        up, less, more, colour = self.up, self.less, self.more, self.colour
        while True:
            p = up[x]
            if not p or (less[p] != x and more[p] != x):
                return
            g = up[p]
            inner = g and (less[g] == p or more[g] == p)
            if inner:
                self.rotate(p if (less[g] == p) == (less[p] == x) else x)
            else:
                colour[x] = colour[p]
            self.rotate(x)
            if inner:
                top = up[x]
                if not top or (less[top] != x and more[top] != x):
                    colour[x] = colour[g]

    def rotate(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        p = up[x]
        g = up[p]
        if less[p] == x:
            b = more[x]
            less[p], more[x] = b, p
        else:
            b = less[x]
            more[p], less[x] = b, p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if less[g] == p:
                less[g] = x
            elif more[g] == p:
                more[g] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int, int]]:
        """Make the path from ``x`` to the root one segment of ``colour``; (old colour, its deepest node, the node above it) of the segments it had."""
        up, more, old = self.up, self.more, []
        below = 0
        while x:
            self.splay(x)
            c, above = self.colour[x], up[x]
            old.append((c, x, above))
            if more[x]:
                self.colour[more[x]] = c
            more[x] = below
            below, x = x, above
        self.colour[below] = colour
        return old


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(number of the last word, period) of squares with a smallest period of d words that end at each word: all periods whose d-word suffix ended last d words before."""
    length, link, ends = automaton(words)
    tree = LinkCut(link)
    for r, state in enumerate(ends, 1):
        for e, deep, above in tree.access(state, r):
            d = r - e
            if e and length[above] < d <= length[deep]:
                yield r - 1, d


def matching(words: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal the words d before them."""
    n, size = 0, 64
    while True:
        i = at + step * n
        lo, hi = (i, min(len(words), i + size)) if step > 0 else (max(d, i - size + 1), i + 1)
        if hi <= lo:
            return n
        same = words[lo:hi] == words[lo - d : hi - d]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return n + int(same.argmin())
        n, size = n + hi - lo, 2 * size


def stretches(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, first and last words) of where runs of a period in [m, 2m) may be; ``first``: n + 1 word offsets of the texts."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, ends, m = mix(words ^ mix(text.astype(np.uint64))), np.arange(len(words)), 1
    while len(ends):
        order = np.argsort(hashes, kind="stable")
        h, e = hashes[order], ends[order]
        same = h[1:] == h[:-1]
        back = e[1:] - e[:-1]
        marked = np.sort(e[1:][same & (back < 2 * m)])
        full = np.sort(e[1:][same & (back < 2 * m) & (back >= m)])
        if len(full):
            cut = np.flatnonzero(np.append(True, (np.diff(marked) > 1) | (text[marked[1:]] != text[marked[:-1]])))
            begin, end = marked[cut], marked[np.append(cut[1:] - 1, len(marked) - 1)]
            lo, hi = np.searchsorted(full, begin), np.searchsorted(full, end, "right")
            long = (end - begin + 1 >= (2 * m + 1 if m > 1 else LEAST_WORDS - 1)) & (hi - lo >= 2)
            begin, end, lo, hi = begin[long], end[long], lo[long], hi[long]
            begin, end = np.maximum(begin, full[lo] - 2 * m), np.minimum(end, full[hi - 1] + 2 * m)
            yield m, np.maximum(begin - 3 * m + 2, first[text[begin]]), end
        # Windows of 2m words end where two windows of m words that occur again meet.
        again = np.append(same, False) | np.append(False, same)
        keep = np.sort(order[again])
        ends, hashes = ends[keep], hashes[keep]
        before = np.searchsorted(ends, ends - m)
        whole = (ends[np.minimum(before, len(ends) - 1)] == ends - m) if len(ends) else np.zeros(0, bool)
        whole &= ends - 2 * m + 1 >= first[text[ends]]
        hashes = mix(hashes[before[whole]] * np.uint64(0x9E3779B97F4A7C15) + hashes[whole])
        ends, m = ends[whole], 2 * m


def runs(words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    found: list[set] = [set() for _ in first[1:]]
    for m, begins, ends in stretches(words, first):
        for begin, end in zip(begins.tolist(), ends.tolist()):
            i = int(np.searchsorted(first, begin, "right")) - 1
            base, text = int(first[i]), words[first[i] : first[i + 1]]
            at, stop, known = begin - base, end - base + 1, {}
            while at < stop:
                block = np.unique(text[at : min(stop, at + 8 * m)], return_inverse=True)[1].tolist()
                last, jump = at + len(block), 0
                for r, d in squares(block):
                    r += at
                    if r >= last:
                        break
                    if r < known.get(d, -1):
                        continue
                    lo = r - d + 1 - matching(text, r - d, d, -1)
                    lo, hi = lo - d, r + 1 + matching(text, r + 1, d, 1)
                    known[d] = hi
                    if hi - lo >= max(LEAST_WORDS, LEAST_TIMES * d):
                        found[i].add((lo, hi - lo, d))
                        if m <= d < 2 * m and hi - 4 * m >= at + 4 * m:  # runs that begin before this one still end soon, later ones begin behind ``jump``
                            last, jump = min(last, max(r, lo + d + 2 * m) + 1), max(jump, hi - 4 * m)
                at = max(at + 4 * m, jump)
    return [sorted(f) for f in found]


def spun(doc_id, n: int) -> tuple[int, int] | None:
    """Where a text of ``n`` words begins to repeat and its period, for one id in ten; None for the others, for null ids and wordless texts."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_KIND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in _KIND.split(", ")]


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, spin: bool = False) -> DataFrame:
    """The ``keep`` columns of ``docs`` with n_runs, the run of greatest length (start, length, period, exponent_milli), a hash of all
    runs, and a hash of the text whose runs are collapsed to their first period. ``spin``: one text in ten is first made to repeat, as :func:`spun` has it."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("row"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w = Words(b.column(2))
                order = np.arange(len(w.starts))
                for i, x in enumerate(b.column(1).to_pylist() if spin else ()):
                    n = int(w.first[i + 1] - w.first[i])
                    if s := spun(x, n):
                        order[w.first[i] + s[0] : w.first[i + 1]] = w.first[i] + s[0] + np.arange(n - s[0]) % s[1]
                raw, out = w.raw.tobytes(), []
                for i, found in enumerate(runs(w.hashes[order], w.first)):
                    of = order[w.first[i] : w.first[i + 1]]
                    drop = np.zeros(len(of) + 1, np.int64)
                    for start, length, period in found:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    of = of[np.cumsum(drop)[:-1] == 0]
                    collapsed = b" ".join([raw[s:e] for s, e in zip(w.starts[of].tolist(), w.ends[of].tolist())])
                    best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
                    exponent = 1000 * best[1] // best[2] if best else None
                    told = "".join(f"{s},{l},{p}\n" for s, l, p in found)
                    out.append((len(found), *(best or (None,) * 3), exponent, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
                columns = list(zip(*out)) or [()] * len(_NAMES)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["row", *_NAMES])

    return unpacked(rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {_KIND}"), *_NAMES)
