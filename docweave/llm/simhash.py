"""SimHash near-duplicate components over a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most three bits differ in at most three
bytes, hence share five positional bytes or more. Candidates are tallied by that count, and those that reach five are
verified by their differing bits.

A list for one positional byte would hold a 256th of all fingerprints, and tallies over such lists grow with the square of the corpus. So a
posting key is three positional bytes together: of any five of eight positions three are in the same half, so that the four triples
of each half (8 keys of 24 bits) find every pair that shares five.

Nothing is gathered or emitted pair by pair:
* documents of one fingerprint are one node from the start;
* lists of up to ``small`` nodes are joined with themselves, tally and verification being the join's condition;
* longer ones are dealt in parts of about ``part`` nodes; each pair of parts meets once in one task, which returns a spanning forest of its
  links (fewer rows than nodes), so that components are whole and rows stay linear in a list's nodes for each part. The tests themselves are
  quadratic in a list whose nodes are not linked; linked nodes leave the tests when they are found.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; under ``shingle`` words the whole
sequence is one shingle; documents without an id carry links, and the component of documents that all lack one is null; repeated rows
share a node; an empty table gives an empty result; extra columns are left alone. Texts are hashed in steps of about 512 KB; a
longer text is taken alone and needs about 30 bytes a byte while its words are found (64 MB: about 2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected
from .staging import staged
from .words import Words, pieces

BITS, BYTES, MOST_BITS = 64, 8, 3
#: Positional bytes that a pair within MOST_BITS shares at least.
LEAST_SHARED = BYTES - MOST_BITS
#: Three positions of one half: any LEAST_SHARED positions hold one of these.
TRIPLES = [tuple(half + i for i in range(4) if i != left_out) for half in (0, 4) for left_out in range(4)]
#: The primes of the public XXH64 hash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the spans [start, end) of ``raw``: spans of one length below 32 bytes together, longer ones by the library."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words8 = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    words4 = np.ndarray((len(raw) + 5,), "<u4", padded, strides=(1,))
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    for i in np.flatnonzero(size >= 32):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed)
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(size[order], np.arange(33))
    for n in range(32):
        rows = order[bounds[n] : bounds[n + 1]]
        if not len(rows):
            continue
        at = starts[rows]
        h = np.full(len(rows), np.uint64(seed) + P5 + np.uint64(n), np.uint64)
        for _ in range(n // 8):
            h = _rotated(h ^ (_rotated(words8[at] * P2, 31) * P1), 27) * P1 + P4
            at = at + 8
        if n % 8 >= 4:
            h = _rotated(h ^ (words4[at].astype(np.uint64) * P1), 23) * P2 + P3
            at = at + 4
        for _ in range(n % 4):
            h = _rotated(h ^ (padded[at].astype(np.uint64) * P5), 11) * P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def fingerprints(text: pa.Array, shingle: int = 3, step: int = 1 << 18) -> np.ndarray:
    """One 64-bit fingerprint for each text: a bit is set if it is set in over half of the hashes of the text's shingles."""
    w = Words(text, lower=True, hashed=False)
    # The words, each with one space behind it.
    lengths = w.ends - w.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = np.full(len(w.starts) and int(ends[-1]) + 1, 0x20, np.uint8)
    place = np.ones(len(joined), bool)
    place[ends] = False
    joined[place] = w.raw[w.word]
    n = w.counts()
    shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.cumsum(shingles) - shingles
    counts = np.zeros((len(n), BITS), np.int64)
    total = int(shingles.sum())
    owner = np.repeat(np.arange(len(n)), shingles)
    for lo in range(0, total, step):
        o = owner[lo : lo + step]
        begin = w.first[:-1][o] + np.arange(lo, lo + len(o)) - first[o]
        end = begin + np.minimum(shingle, n[o]) - 1
        h = xxh64(joined, starts[begin], ends[end])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        counts[o[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node: the fingerprint of each (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))], ["doc_id", "node"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long")


def _byte(c: Column, position: int) -> Column:
    return F.shiftrightunsigned(c, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def posting_keys(node: Column) -> Column:
    """The keys of a fingerprint's lists: number of the triple, then its three bytes."""
    each = [F.shiftleft(_byte(node, a), 16).bitwiseOR(F.shiftleft(_byte(node, b), 8)).bitwiseOR(_byte(node, c)) for a, b, c in TRIPLES]
    return F.array(*[x + F.lit(t << 24).cast("long") for t, x in enumerate(each)])


def n_shared(a: Column, b: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    return sum(((_byte(a.bitwiseXOR(b), k) == 0).cast("int") for k in range(BYTES)), F.lit(0))


def forest(nodes: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected by links among ``nodes`` (distinct uint64): each found node leaves the search."""
    low, high, top = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080), np.uint8(BYTES - LEAST_SHARED)
    left, a, b = nodes, [], []
    while len(left):
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            v = open_.pop()
            x = left ^ v
            tally = np.flatnonzero(np.bitwise_count((((x & low) + low) | x) & high) <= top)  # bytes that differ
            hit = tally[np.bitwise_count(x[tally]) <= most_bits]
            if len(hit):
                new = left[hit]
                a.append(np.full(len(new), v))
                b.append(new)
                open_ += new.tolist()
                left = np.delete(left, hit)
                open_ = [np.uint64(o) for o in open_]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def dealt_links(members: DataFrame, part: int) -> DataFrame:
    """Links (a, b) that connect the members (key, node, size) of long lists: every two parts of a list meet in one task."""
    parts = F.ceil(F.col("size") / part).cast("int")
    rows = members.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("mine")))
    rows = rows.select("key", "node", "mine", F.explode(others).alias("other")).select("key", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        a, b = forest(np.asarray(table["node"]).view(np.uint64))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, small: int = 64, part: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept (the smallest id of its component)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = staged(sketches(rows, shingle), "fingerprints")
    nodes = staged(sketch.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")

    keyed = nodes.select("node", F.explode(posting_keys(F.col("node"))).alias("key"))
    size = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "list-sizes")
    lists = staged(keyed.join(size.hint("merge"), "key"), "lists")
    few = lists.where(F.col("size") <= small)
    a, b = F.col("a"), F.col("b")
    met = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")).hint("merge"), "key")
    links = met.where((a < b) & (n_shared(a, b) >= LEAST_SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS)).select("a", "b")
    links = links.unionAll(dealt_links(lists.where(F.col("size") > small), part)).distinct()

    labels = staged(connected(staged(links, "verified")), "labels")
    members = nodes.join(labels.hint("merge"), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    least = staged(members.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    component = staged(members.join(least.hint("merge"), "label").select("node", "component_id"), "components")
    out = sketch.join(component.hint("merge"), "node")
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
