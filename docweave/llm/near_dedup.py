"""Near-duplicate components with circulant MinHash.

Signature: one permutation scatters shingles over Z(2**32); coordinate k is the minimum of a second permutation after a circular
shift by k steps (C-MinHash, Li and Li, 2021), so two permutations give all coordinates. Bands of coordinates propose
pairs, exact set comparison decides them, and links are contracted to components.

No group is gathered, and no bucket is capped:
* texts with the same shingle set are one node from the start;
* a bucket of up to ``small`` nodes proposes all its pairs; a larger one proposes each node with two centres;
* larger buckets whose nodes are then still in different components are compared exactly and completely, in blocks of
  ``block`` x ``block`` nodes, except inside the largest component, where no test can change the result.
Bands have as many rows as keep the chance to miss a pair at the threshold below 1e-6 (for independent coordinates); every pair
that shares a band and whose set sizes allow a link is decided on full sets.

Defined cases: null and empty texts and texts without words have the empty set and are linked with nothing; fewer than
``shingle`` words form one shingle; repeated rows share a node; rows without an id carry links like any other, and the component of
rows that all lack one is null; an empty table gives an empty result; extra columns are left alone. Sets are kept as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected
from .staging import prefilter, staged, without
from .words import Words, mix, pieces, windows, tidy

COORDS = 120
_STEP = 0x9E3779B1  # odd, so that its multiples are distinct shifts


def band_rows(percent: int) -> int:
    """Rows of a band: the most (of the divisors of COORDS up to 6) that miss a pair at the threshold with a chance below 1e-6."""
    return max([1, *(r for r in range(2, 7) if (1 - (percent / 100) ** r) ** (COORDS // r) < 1e-6)])


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the n + 1 offsets of the texts."""
    w = Words(text, lower=True)
    keys, at = windows(w.hashes, w.first, shingle)
    owner = w.text_of_word()[at]
    counts = w.counts()
    for k in range(1, shingle):  # whole short texts
        few = np.flatnonzero(counts == k)
        if len(few):
            h = sum(mix(w.hashes[w.first[few] + i] + np.uint64(i)) for i in range(k)) * np.uint64(2 * k + 1)
            keys, owner = np.concatenate([keys, mix(h)]), np.concatenate([owner, few])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.searchsorted(owner[new], np.arange(len(text) + 1))


def node_ids(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def permute(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """In place, the bijection of 32-bit values that ends the public MurmurHash3."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def signatures(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDS minima for each non-empty set, as uint32 rows."""
    full = np.flatnonzero(np.diff(first))
    out = np.empty((COORDS, len(full)), np.uint32)
    step = 1 << 16  # sets are taken in runs that stay in the processor's cache
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(first[full], first[full[i]] + step)))
        lo, hi = first[full[i]], first[full[j - 1] + 1]
        scattered = (keys[lo:hi] >> np.uint64(32)).astype(np.uint32)  # the first permutation: mixed bits of the shingle's hash
        shifted, spare, starts = np.empty_like(scattered), np.empty_like(scattered), first[full[i:j]] - lo
        for k in range(COORDS):
            np.add(scattered, np.uint32(k * _STEP & 0xFFFFFFFF), out=shifted)
            out[k, i:j] = np.minimum.reduceat(permute(shifted, spare), starts)
        i = j
    return out.T


def sketches(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, name, n_shingles, node (hash of the whole set, null if empty), bands (keys of its bands of coordinates) of (doc_id, name, text)."""
    height = band_rows(percent)
    n_bands = COORDS // height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(n_bands, dtype=np.uint64))
        for batch in batches:
            for b in pieces(batch, "text"):
                keys, first = shingle_sets(b.column(2), shingle)
                n = np.diff(first)
                full, sig = np.flatnonzero(n), signatures(keys, first)
                node = node_ids(keys, first)
                band = np.repeat(salt[None], len(full), 0)
                for r in range(height):
                    band = mix(band ^ sig[:, r::height].astype(np.uint64))
                rows = np.full(b.num_rows, -1)
                rows[full] = np.arange(len(full))
                at = pa.array(rows, mask=rows < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * n_bands, pa.int32()), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, mask=n == 0), lists.take(at)], ["doc_id", "name", "n_shingles", "node", "bands"])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name string, n_shingles long, node long, bands array<long>")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles as bytes) of (node, text); rows whose text has another set (an id that names several texts) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                keys, first = shingle_sets(b.column(1), shingle)
                sets = pa.RecordBatch.from_arrays([b.column(0), pa.array([keys[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["node", "shingles"])
                yield sets.filter(pa.array(node_ids(keys, first) == np.asarray(b.column(0))))

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, shingles binary")


def similar_enough(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")).hint("merge"), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = similar_enough(common, len(x), len(y), percent)
            yield b.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices, ``width`` shingles at a time."""
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate([sizes_l, sizes_r]))
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(values), width):
        i, j = np.searchsorted(at, [lo, lo + width])
        x = np.zeros((len(left) + len(right), width), np.float32)
        x[row[i:j], at[i:j] - lo] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def blocked_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Exact links across components inside unresolved large buckets (key, node), found block by block."""
    rows = members.join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    rows = staged(rows, "large-buckets")
    parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    largest = staged(largest, "largest")
    rows = rows.join(largest.hint("merge"), "key").withColumn("outside", F.col("label") != F.col("largest"))
    n_all, n_out = F.ceil(F.col("n") / block).cast("int"), F.ceil((F.col("n") - F.col("most")) / block).cast("int")
    h = F.xxhash64("node", F.lit(7))
    mine = F.struct(F.pmod(h, n_all).cast("int").alias("i"), F.pmod(h, n_out).cast("int").alias("j"))
    right = rows.select("key", "node", "label", F.lit(False).alias("left"), mine["i"].alias("i"), F.explode(F.sequence(F.lit(0), n_out - 1)).alias("j"))
    left = rows.where("outside").select("key", "node", "label", F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("i"), mine["j"].alias("j"))
    dealt = left.unionAll(right).join(sets.hint("merge"), "node").select("key", "i", "j", "left", "node", "label", "shingles")

    def run(table: pa.Table) -> pa.Table:
        is_left = np.asarray(table["left"])
        node, label = np.asarray(table["node"]), np.asarray(table["label"])
        sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        l, r = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        if not len(l) or not len(r):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        common = common_counts([sets_[i] for i in l], [sets_[i] for i in r])
        n = np.array([len(x) for x in sets_])
        hit = similar_enough(common, n[l][:, None], n[r][None], percent) & (label[l][:, None] != label[r][None])
        x, y = np.nonzero(hit)
        _, one = np.unique(np.stack([label[l[x]], label[r[y]]]), axis=1, return_index=True)  # one link joins two components
        return pa.table({"a": node[l[x[one]]], "b": node[r[y[one]]]})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80, small: int = 32, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links have 100 * intersection >= percent * union."""
    body = F.col(text).cast("string")
    # Texts are found again by their id, or by their digest where they have none.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(doc_id).isNull(), F.md5(body)).alias("name"), body.alias("text"))
    sketch = staged(sketches(rows, shingle, percent), "sketches")
    filled = sketch.where("node is not null")
    nodes = staged(filled.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")

    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    # Tables of counts and minima are written out: a join of two plain shuffles is one that Spark can split where a key is frequent.
    size = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = staged(keyed.join(size.hint("merge"), "key"), "buckets")
    close = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    few = shared.where(F.col("size") <= small)
    pairs = few.select("key", F.col("node").alias("a"), "n").join(few.select("key", F.col("node").alias("b"), F.col("n").alias("m")).hint("merge"), "key").where((F.col("a") < F.col("b")) & close)
    many = shared.where(F.col("size") > small)
    centres = staged(many.groupBy("key").agg(F.min(F.struct("node", "n")).alias("x"), F.max(F.struct("node", "n")).alias("y")), "centres")
    stars = many.join(centres.hint("merge"), "key").select("node", "n", F.explode(F.array("x", "y")).alias("c")).select(F.col("node").alias("a"), F.col("c.node").alias("b"), "n", F.col("c.n").alias("m"))
    stars = stars.where((F.col("a") != F.col("b")) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = staged(pairs.select("a", "b").unionAll(stars).distinct(), "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionAll(many.select("node")).distinct()
    one = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("name").alias("name"))
    wanted = staged(wanted.join(one.hint("merge"), "node"), "wanted")
    texts = prefilter(rows.where("doc_id is not null").withColumn("id", F.xxhash64("doc_id")), "id", wanted.where("doc_id is not null").select(F.xxhash64("doc_id").alias("id")))
    texts = texts.join(wanted.drop("name").hint("merge"), "doc_id").select("node", "text")
    nameless = wanted.where("doc_id is null")
    if not nameless.isEmpty():
        texts = texts.unionAll(rows.where("doc_id is null").join(nameless.drop("doc_id").hint("merge"), "name").select("node", "text"))
    sets = staged(sets_of(texts, shingle).dropDuplicates(["node"]), "sets")

    links = staged(confirmed(pairs, sets, percent), "confirmed")
    labels = staged(connected(links), "labels")
    if not many.isEmpty():
        more = staged(blocked_links(many.select("key", "node"), sets, labels, percent, block).distinct(), "blocked")
        if not more.isEmpty():
            labels = staged(connected(links.unionAll(more)), "labels")

    members = filled.select("doc_id", "n_shingles", "node").join(labels.hint("merge"), "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    least = staged(members.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    out = members.join(least.hint("merge"), "label").select("doc_id", "n_shingles", "component_id")
    out = out.unionAll(sketch.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component."""
    gone = near_components(docs, text, doc_id, **options).where("not kept").select("doc_id").distinct()
    return without(docs, staged(gone, "gone"), doc_id=F.col(doc_id))
