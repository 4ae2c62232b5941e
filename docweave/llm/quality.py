"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network in numpy.

Random indexing (Sahlgren, 2005): every context item has a fixed sparse ternary vector, made from its hash; a word's vector sums those
of the items within two words of it, over the whole corpus. Items are words and word shapes (``Xx``, ``X!``, ``x$``, and whether
the word repeats the one before). Each item of the learning documents has a vector of its own, keyed by its 64-bit hash; if they
hold more than ``most_items`` items, the most frequent have. All other words share ``2**BITS`` vectors by hash, all other shapes as
many. So the vectors are at most ``(most_items + 2 * 2**BITS) * DIM`` numbers whatever the corpus holds: each task sums its own,
Spark adds them by item, and the table is broadcast (6.3 MB with the bounds given).

A document is the mean and spread of its words' and shapes' unit vectors, and the mean over its distinct words; nothing else enters. The
network is fitted on the driver to the pooled vectors of at most about ``most_labels`` labelled documents (drawn by a hash of id and
label; the bound is that parameter), and a temperature fitted to held-back learning documents calibrates it. Every document
is scored on its whole text.

Defined cases: null and empty texts have a vector of zeros and are scored; a document with several labels is learned with each; rows
without an id are scored and never learned from; without labels of both kinds every score is the share of label 1 (0.5 if none);
repeated rows score alike; an empty table gives an empty result; extra columns are left alone. A long text is read in
steps; 64 MB of text takes a worker less than 1.1 GB (tested), most of it numbers for its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import staged, unpacked
from .words import Words, mix, parts, pieces, span_hashes

BITS, DIM, NEAR, NONZERO = 13, 24, 2, 4
_KIND = np.zeros(256, np.uint8)  # classes of bytes for shapes; others stand for themselves
_KIND[:128] = np.arange(128)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = ord("X"), ord("x"), ord("9"), ord("x")


@dataclass
class Lexicon:
    """Rows of the table of vectors: one for each ``known`` item (sorted hashes), then those that other words and other shapes share."""

    known: np.ndarray

    def __len__(self) -> int:
        return len(self.known) + (2 << BITS)

    def rows(self, hashes: np.ndarray, shape: bool) -> np.ndarray:
        other = (hashes >> np.uint64(64 - BITS)).astype(np.int32) + (len(self.known) + (int(shape) << BITS))
        if not len(self.known):
            return other
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, other).astype(np.int32)

    def index_vectors(self) -> np.ndarray:
        """The sparse ternary vector of each row, made from the item's hash (or from the row's number among the shared ones)."""
        keys = np.concatenate([self.known, np.arange(2 << BITS, dtype=np.uint64)])
        out, at = np.zeros((len(self), DIM), np.int8), np.arange(len(self))
        for k in range(NONZERO):
            h = mix(keys * np.uint64(NONZERO) + np.uint64(k))
            out[at, (h % np.uint64(DIM)).astype(int)] = np.where(h >> np.uint64(63), 1, -1)
        return out


def items(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash of each word, hash of its shape, and its text (ascending), in steps of bounded size."""
    before, last = -1, np.uint64(0)  # text and hash of the last word
    for part, owners in parts(text):
        w = Words(part)
        if not len(w.starts):
            continue
        kind = _KIND[w.raw]
        keep = np.ones(len(w.raw), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[w.starts] = True
        keep &= w.word
        at = np.zeros(len(w.raw) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        shape = span_hashes(kind[keep], at[w.starts], at[w.ends])
        owner = owners[w.text_of_word()]
        again = np.append(last, w.hashes[:-1]) == w.hashes
        again &= np.append(before, owner[:-1]) == owner
        before, last = owner[-1], w.hashes[-1]
        yield w.hashes, mix(shape + again.astype(np.uint64)), owner


def rows_of(text: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, row of its shape, and its text."""
    got = [(lexicon.rows(w, False), lexicon.rows(s, True), t.astype(np.int32)) for w, s, t in items(text)]
    return tuple(np.concatenate(x) if got else np.zeros(0, np.int32) for x in (zip(*got) if got else ((), (), ())))


def context(word: np.ndarray, shape: np.ndarray, text: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors around each word, inside its text."""
    own = index[word] + index[shape]
    out = np.zeros(own.shape, np.int16)
    for d in range(1, NEAR + 1):
        same = (text[d:] == text[:-d])[:, None]
        out[d:] += own[:-d] * same
        out[:-d] += own[d:] * same
    return out


def lexicon_of(texts: DataFrame, most_items: int) -> Lexicon:
    """The most frequent items of a column ``text``; at most ``most_items`` hashes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                for word, shape, _ in items(b.column(0)):
                    keys, n = np.unique(np.concatenate([word, shape]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["item", "n"])

    counted = texts.select("text").mapInArrow(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.desc("n"), "item").limit(most_items).select("item").toArrow()
    return Lexicon(np.sort(np.asarray(got["item"]).astype(np.int64).view(np.uint64)))


STEP = 1 << 17  # words whose contexts are summed at a time


def word_vectors(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> np.ndarray:
    """The unit vectors of all rows of the lexicon (zeros where unseen), of which one each reaches the driver."""
    rows, names = docs.select(F.col(text).cast("string").alias("text")), [f"v{i}" for i in range(DIM)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        index, total, seen = lexicon.index_vectors(), np.zeros((DIM, len(lexicon))), np.zeros(len(lexicon), bool)
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                word, shape, owner = rows_of(b.column(0), lexicon)
                for lo in range(0, len(word), STEP):
                    hi = min(len(word), lo + STEP)
                    wide = slice(max(0, lo - NEAR), hi + NEAR)
                    around = context(word[wide], shape[wide], owner[wide], index)[lo - wide.start :][: hi - lo]
                    both = np.concatenate([word[lo:hi], shape[lo:hi]])
                    for i in range(DIM):
                        total[i] += np.bincount(both, np.tile(around[:, i], 2), minlength=len(lexicon))
                    seen[both] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[i, at].astype(np.int64)) for i in range(DIM)]], ["item", *names])

    sums = rows.mapInArrow(run, "item int, " + ", ".join(f"{n} long" for n in names)).groupBy("item").agg(*[F.sum(n).alias(n) for n in names])
    got = sums.toArrow()
    out = np.zeros((len(lexicon), DIM), np.float32)
    out[np.asarray(got["item"])] = np.stack([np.asarray(got[n]) for n in names], 1)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def pooled(text: pa.Array, lexicon: Lexicon, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean of the word vectors, of the shape vectors, of those of distinct words, and spread of word and shape vectors."""
    word, shape, owner = rows_of(text, lexicon)
    n = np.bincount(owner, minlength=len(text))

    def mean(ids: np.ndarray, own: np.ndarray, count: np.ndarray, table: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(own, table[ids, i], minlength=len(text)) for i in range(DIM)], 1) / np.maximum(1, count)[:, None]

    kinds = np.unique(owner.astype(np.int64) * len(lexicon) + word)
    of, kind = kinds // len(lexicon), kinds % len(lexicon)
    a, b = mean(word, owner, n, vectors), mean(shape, owner, n, vectors)
    c = mean(kind, of, np.bincount(of, minlength=len(text)), vectors)
    squares = vectors**2
    spread = [np.sqrt(np.maximum(0, mean(ids, owner, n, squares) - m**2)) for ids, m in ((word, a), (shape, b))]
    return np.concatenate([a, b, c, *spread], 1).astype(np.float32)


@dataclass
class QualityModel:
    lexicon: Lexicon
    vectors: np.ndarray
    layers: tuple | None
    prior: float

    def score(self, text: pa.Array) -> np.ndarray:
        x = pooled(text, self.lexicon, self.vectors)
        return np.full(len(text), self.prior) if self.layers is None else probability(x, self.layers)


def logits(x: np.ndarray, layers: tuple) -> np.ndarray:
    mean, scale, w1, b1, w2, b2, _ = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def probability(x: np.ndarray, layers: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(x, layers) / layers[-1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> tuple:
    """Adam on the logistic loss; every tenth document is held back to fit the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, learn = order[::10], np.delete(order, np.s_[::10])
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            dh = d[:, None] * p[2] * (1 - h**2)
            grads, t = [z[i].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum()], t + 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    layers = (mean, scale, *p, 1.0)
    s = logits(x[back], layers)
    grid = np.geomspace(0.3, 10, 71)
    loss = [np.logaddexp(0, np.where(y[back] == 1, -s, s) / t).mean() for t in grid]
    return (*layers[:-1], float(grid[int(np.argmin(loss))]))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_labels: int = 20000, most_items: int = 49152) -> QualityModel:
    """``docs`` give the word vectors (no labels needed); ``labels`` (id, label) are all that may be learned from."""
    labels = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").distinct()
    n = labels.count()
    draw = F.pmod(F.xxhash64("id", "label", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
    # At most about most_labels short rows, which are broadcast: the texts are not shuffled.
    labels = staged(labels.where(draw < min(1.0, most_labels / max(1, n))), "labels")
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(labels), "id").select("text", "id", "label")
    lexicon = lexicon_of(known, most_items)
    vectors = word_vectors(docs, lexicon, text)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                x = pooled(b.column(0), *shared.value)
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["id", "label", "x"])

    got = known.mapInArrow(run, f"id {known.schema['id'].dataType.simpleString()}, label int, x array<float>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = np.asarray(got["label"]).astype(float)
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or prior in (0.0, 1.0):
        return QualityModel(lexicon, vectors, None, prior)
    return QualityModel(lexicon, vectors, fit(np.array(got["x"].to_pylist(), np.float64), y), prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` with score and predicted."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], ["row", "score"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return unpacked(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "score", "predicted")
