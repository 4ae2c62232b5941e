"""Edit-aware token counts.

A text is cut into pre-tokens, the parts that byte-pair encoding never merges across. Leaves of a segment tree hold runs of about
``LEAF`` pre-tokens with their characters and tokens; inner nodes hold sums. An edit finds its leaves by descending the character sums,
re-encodes from two characters before it (what a pre-token's look-ahead can see) to the first old boundary behind it at
which old and new cuts meet again, and updates the sums above the leaves it touched. The rest of the text is never read again.

The vocabulary file of a public tokenizer is read once, on the driver, and broadcast (its size is fixed).

Defined cases: null text counts 0 tokens and edits insert into the empty text; edits apply in order, each in the coordinates (code
points) of the text that the one before left, and are clipped to it; null edits are none; repeated rows count alike; an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .staging import unpacked
from .words import pieces

#: The public pre-token pattern of the 50k byte-level vocabulary, which looks one character past a token at most
#: (or past a run of white space), and its file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF, SEES, CACHED = 64, 2, 400_000


class Counter:
    """Token counts of pre-tokens, with a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.cut = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = len(self.encode(t))
        return list(map(known.__getitem__, tokens))


class TokenTree:
    """The pre-tokens of one text in leaves, under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        tokens = counter.cut(text)
        self.fill(tokens, counter.counts(tokens))

    def fill(self, tokens: list[str], counts: list[int]) -> None:
        n = max(1, -(-len(tokens) // LEAF))
        self.width = 1 << (n - 1).bit_length()
        self.leaves = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, n * LEAF, LEAF)]
        self.leaves += [([], [])] * (self.width - n)
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        for i, (t, c) in enumerate(self.leaves[:n]):
            self.sums[self.width + i] = sum(map(len, t)), sum(c)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(t for ts, _ in self.leaves for t in ts)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text if at the end), and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            right = begin + left <= at and self.sums[2 * node + 1, 0] > 0
            node, begin = 2 * node + right, begin + left * right
        return node - self.width, begin

    def put(self, leaf: int, tokens: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = tokens, counts
        node = self.width + leaf
        self.sums[node] = sum(map(len, tokens)), sum(counts)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        first, begin = self.find(max(0, start - SEES))
        while first > 0 and begin > max(0, start - SEES - 1):  # the pre-token before a boundary looks past it
            first -= 1
            begin -= int(self.sums[self.width + first, 0])
        tokens, counts = self.leaves[first]
        keep, at = 0, begin
        while keep < len(tokens) and at + len(tokens[keep]) <= start - SEES:
            at += len(tokens[keep])
            keep += 1
        # Old text from the kept boundary on, leaf by leaf, until old and new boundaries meet behind the edit.
        old, last = tokens[keep:], first
        reach = begin + int(self.sums[self.width + first, 0])
        while reach < end and last + 1 < self.width:
            last += 1
            old = old + self.leaves[last][0]
            reach += int(self.sums[self.width + last, 0])
        grow = len(new) - (end - start)
        while True:
            body = "".join(old)
            fresh = self.counter.cut(body[: start - at] + new + body[end - at :])
            ends_old = set(np.cumsum([0, *map(len, old)]).tolist())
            whole, pos, meet = last + 1 == self.width or reach == self.n_chars, 0, None
            seen = len(body) + grow - SEES  # cuts beyond may depend on text that was not read
            for i, t in enumerate(fresh):
                if pos - grow >= end - at and pos >= start - at + len(new) and pos - grow in ends_old and (pos + len(t) <= seen or whole):
                    meet = i, pos - grow
                    break
                pos += len(t)
            if meet or whole:
                break
            last += 1
            old = old + self.leaves[last][0]
            reach += int(self.sums[self.width + last, 0])
        if meet:
            n, left = meet[0], 0
            skipped = 0
            while left < meet[1]:
                left += len(old[skipped])
                skipped += 1
            rest = old[skipped:]
            fresh = fresh[:n]
        else:
            rest = []
        self.encoded += len(fresh)
        joined = tokens[:keep] + fresh + rest
        old_counts = [c for leaf in range(first, last + 1) for c in self.leaves[leaf][1]]
        cs = counts[:keep] + self.counter.counts(fresh) + (old_counts[len(old_counts) - len(rest) :] if rest else [])
        share = max(1, -(-len(joined) // (last - first + 1)))
        for k, leaf in enumerate(range(first, last + 1)):
            self.put(leaf, joined[k * share : (k + 1) * share], cs[k * share : (k + 1) * share])
        if share > 4 * LEAF:  # leaves that grew too long are dealt anew
            self.fill([t for ts, _ in self.leaves for t in ts], [c for _, x in self.leaves for c in x])


def ranks_of(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def edits_for(docs: DataFrame, pattern: str, new: str, text: str = "text", needs: str = "") -> DataFrame:
    """``docs`` with an ``edits`` column that replaces every match of ``pattern`` (last match first); ``needs``: a pattern that is found in each match."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, may = regex.compile(pattern).finditer, regex.compile(needs).search
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for b in pieces(batch, "text"):
                found = [[] if t is None or not may(t) else [{"start": m.start(), "end": m.end(), "text": new} for m in find(t)][::-1] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["row", "edits"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, edits array<struct<start:int,end:int,text:string>>")
    return unpacked(out, "edits")


def count_edited(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", edits: str = "edits", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with n_tokens, n_edits, n_tokens_edited and n_reencoded (pre-tokens that edits had encoded again)."""
    keep = [c for c in docs.columns if c != edits] if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"), F.col(edits).alias("edits"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for b in pieces(batch, "text"):
                out = []
                for t, es in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    tree = TokenTree(t or "", counter)
                    before = tree.n_tokens
                    for e in es or ():
                        tree.edit(e["start"], e["end"], e["text"] or "")
                    out.append((before, len(es or ()), tree.n_tokens, tree.encoded))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in out], pa.int64()) for i in range(4)]], ["row", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long")
    return unpacked(out, "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")
