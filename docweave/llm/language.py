"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

The classifier is fastText's (Joulin et al., 2016) in numpy. It is fitted on the driver by stochastic gradient descent to at most
about ``per_label`` labelled documents of each of the ``most_labels`` most frequent languages, and at most about ``most_bytes`` of subword
counts, drawn by a hash of their id (the bounds are these parameters); every document is then scored over its whole text inside Spark tasks. As averaging and the softmax's
scores are linear, embeddings and output weights are folded into one table of bucket scores for that.

Rejection: the softmax has one more class, no language. Its examples are made of sampled texts: half have their characters shuffled,
half have their letters exchanged at random. Another sample, a tenth of the labelled documents and at most about ``most_held``, with texts
made of it, is never learned from and scored in Spark tasks. A temperature fitted to its scores calibrates the probabilities, and
``min_score`` is the lowest score from which the texts that would be accepted are wrong (of another language than predicted, or of none)
in at most ``most_wrong`` of all cases by an upper confidence bound (Wilson's, one-sided, 95 %). Where no score shows that much (a few hundred
texts without an error are needed for 1 %), it is the score with the least bound; ``error_bound`` says which bound holds.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and rejected; one-letter texts are scored; without any
labelled document every text is ``und``; labels beyond the ``most_labels`` most frequent are not learned; repeated rows score alike; an empty
table gives an empty result; rows without an id are in no fold (``fold`` gives -1, so that they are learned from and not held out); extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .staging import unpacked
from .words import LOWER, bytes_of, give_back, pieces, tidy, with_body

BITS, DIM, ORDERS = 15, 16, (2, 3, 4)
#: Bytes that are neither ASCII letters nor part of longer characters act as word boundaries.
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123], _CLEAN[128:] = np.arange(97, 123), np.arange(128, 256)
UND = "und"
MOST_NORM = 4.0
#: Text bytes that one vectorised step takes, also of one long text.
STEP = 1 << 18


def subwords(text: pa.Array, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all byte n-grams of the texts (a space on both sides, runs of spaces skipped), and each one's text; ``step`` bytes at a time."""
    raw, offsets = bytes_of(pc.binary_join_element_wise(" ", pc.fill_null(text, ""), " ", ""))
    most = max(ORDERS)
    for lo in range(0, len(raw), step):
        hi = min(lo + step, len(raw))
        n = hi - lo
        wide = np.zeros(n + most, np.uint8)
        part = raw[lo : hi + most]
        wide[: len(part)] = _CLEAN[LOWER[part]]
        i, j = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi)
        edges = np.clip(offsets[i : j + 1] - lo, 0, n)
        owner = np.repeat(np.arange(i, j), np.diff(edges))
        left = np.repeat((offsets[i + 1 : j + 1] - lo).astype(np.int32), np.diff(edges)) - np.arange(n, dtype=np.int32)  # bytes to the text's end
        blank = (wide[:n] == 32) & (wide[1 : n + 1] == 32)
        code = np.zeros(n, np.uint32)
        for k in range(most):
            code |= wide[k : n + k].astype(np.uint32) << np.uint32(8 * k)
            if k + 1 in ORDERS:
                fits = np.flatnonzero((left > k) & ~blank)
                h = (code[fits] + np.uint32(0x7F4A7C15 * (k + 1) & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                yield ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64), owner[fits]


def counted(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text, weights summing to 1."""
    parts = [np.unique(o << BITS | b, return_counts=True) for b, o in subwords(text)] or [(np.zeros(0, np.int64),) * 2]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([m for _, m in parts]), len(keys)).astype(np.int64)
    at = np.searchsorted(keys >> BITS, np.arange(len(text) + 1))
    return [((keys[i:j] & (1 << BITS) - 1).astype(np.uint16), (n[i:j] / max(1, n[i:j].sum())).astype(np.float32)) for i, j in zip(at[:-1], at[1:])]


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  # bucket x (labels, then no language): embedding times output weights
    bias: np.ndarray
    temperature: float = 1.0
    min_score: float = 0.5
    error_bound: float = 1.0

    def logits(self, text: pa.Array) -> np.ndarray:
        n, z = np.zeros(len(text)), np.zeros((len(text), len(self.bias)))
        for b, o in subwords(text):
            n += np.bincount(o, minlength=len(text))
            for c in range(len(self.bias)):
                z[:, c] += np.bincount(o, self.scores[b, c], len(text))
        return z / np.maximum(1, n)[:, None] + self.bias

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best label and its calibrated probability."""
        p = softmax(self.logits(text) / self.temperature)[:, : len(self.labels)]
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The one of a fixed grid under which held-back labels are likeliest."""
    grid = np.geomspace(0.5, 20, 121)
    return float(grid[np.argmin([-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])]) if len(y) else 1.0


def accepted_errors(score: np.ndarray, wrong: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct scores, falling, and the upper bound of the share of wrong texts from each on (Wilson's at ``z``; the share itself at 0)."""
    order = np.argsort(-score, kind="stable")
    n = np.arange(1, len(order) + 1)
    p = np.cumsum(wrong[order]) / n
    bound = (p + z * z / (2 * n) + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    last = np.append(score[order][1:] < score[order][:-1], True)[: len(order)]  # equal scores are accepted together
    return score[order][last], bound[last]


def threshold(score: np.ndarray, wrong: np.ndarray, most_wrong: float, z: float = 0.0) -> float:
    """The lowest score from which at most ``most_wrong`` of the texts are wrong; just above the highest if there is none."""
    scores, bound = accepted_errors(score, wrong, z)
    fine = np.flatnonzero(bound <= most_wrong)
    return float(scores[fine[-1]]) if len(fine) else float(np.nextafter(score.max(initial=0.0), 2.0))


def calibrate(model: LanguageModel, z: np.ndarray, y: np.ndarray, most_wrong: float, confidence: float = 1.645) -> LanguageModel:
    """``model`` with temperature, min_score and error_bound from held-back logits and classes; unchanged if there are none."""
    if not len(y):
        return model
    t = temperature(z, y)
    p = softmax(z / t)[:, : len(model.labels)]
    scores, bound = accepted_errors(p.max(1), p.argmax(1) != y, confidence)
    least = np.flatnonzero(bound <= max(most_wrong, bound.min()))[-1]
    return LanguageModel(model.labels, model.scores, model.bias, t, float(scores[least]), float(bound[least]))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], names: list[str | None], epochs: int = 8, rate: float = 0.3, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent, one document a step. A name of None: no language. The model is not calibrated yet.

    A step moves a document's mean embedding by the rate times its gradient, however many subwords share it, and output weights keep a
    bounded norm, so that long documents and wrong labels cannot make the descent diverge.
    """
    labels = sorted({x for x in names if x is not None})
    place = {x: i for i, x in enumerate(labels)} | {None: len(labels)}
    y = np.array([place[x] for x in names])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(place))).astype(np.float32), np.zeros(len(place), np.float32)
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            b, w = samples[i]
            lr, step = rate * (1 - step / steps), step + 1
            h = w @ emb[b]
            g = softmax(h @ out + bias)
            g[y[i]] -= 1
            back_h = out @ g
            out -= lr * np.outer(h, g)
            out *= min(1.0, MOST_NORM / np.linalg.norm(out))
            bias -= lr * 0.1 * g
            emb[b] -= lr * np.outer(w / (w @ w + 1e-6), back_h)
    return LanguageModel(labels, emb @ out, bias)


def without_language(text: str, rng: np.random.Generator) -> str:
    """The characters of a text shuffled, or its letters exchanged at random."""
    if rng.random() < 0.5:
        return rng.permutation(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).copy()).tobytes().decode("utf-32-le")
    letters = sorted({c for c in text.lower() if c.isalpha()})
    return text.lower().translate(dict(zip(map(ord, letters), rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(letters)).tolist())))


def learn(rows: DataFrame, text: str, label: str, doc_id: str, per_label: int = 800, most_labels: int = 256, most_bytes: int = 256 << 20, most_held: int = 20_000, most_wrong: float = 0.01) -> LanguageModel | None:
    """Fit to ``rows``, all of which may be learned from; only subword counts of the bounded sample, and scores of the held-back one, reach the driver."""
    spark = rows.sparkSession
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("label is not null and text is not null")
    bytes_ = F.least(F.lit(1 << BITS), F.octet_length("text") * len(ORDERS)).cast("long") * 6  # of a text's counts, at most
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_).alias("bytes")).orderBy(F.desc("n"), "label").limit(most_labels).collect()
    if not sizes:
        return None
    shares = {r["label"]: min(1.0, per_label / r["n"]) for r in sizes}
    scale = min(1.0, most_bytes / max(1, sum(shares[r["label"]] * r["bytes"] for r in sizes)))
    shares = spark.createDataFrame([(x, share * scale) for x, share in shares.items()], "label string, share double")
    n = sum(r["n"] for r in sizes)
    held = min(0.1, most_held / n) if n > 20 else 0.0
    draw = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    rows = rows.join(F.broadcast(shares), "label")
    back, rows = rows.where(draw("held") < held), rows.where((draw("held") >= held) & (draw("language") < F.col("share")))
    spoilt = min(1.0, per_label / sum(min(per_label, r["n"]) for r in sizes))  # no language is learned from at most as many texts

    def with_made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(ids, labels, texts), and the same for texts made of them."""
        for batch in batches:
            for b in pieces(batch, "text"):
                ids, texts = b.column(0), b.column(1)
                rngs = [np.random.default_rng(zlib.crc32(t.encode("utf-8", "replace"))) for t in texts.to_pylist()]
                made = [i for i, r in enumerate(rngs) if r.random() < spoilt]
                extra = pa.array([without_language(texts[i].as_py(), rngs[i]) for i in made], pa.string())
                yield ids, b.column(2), texts
                yield ids.take(pa.array(made, pa.int64())), pa.nulls(len(made), pa.string()), extra

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names, texts in with_made(batches):
            c = counted(texts)
            yield pa.RecordBatch.from_arrays([ids, names, pa.array([x.tobytes() for x, _ in c], pa.binary()), pa.array([w.tobytes() for _, w in c], pa.binary())], ["id", "label", "b", "w"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", "text", "label").mapInArrow(tidy(counts), f"id {kind}, label string, b binary, w binary").toArrow()
    if not got.num_rows:  # a table so small that all of it was held back
        return None
    order = pc.sort_indices(got, [("id", "ascending"), ("label", "ascending"), ("w", "ascending")]).to_pylist()
    samples = [(np.frombuffer(got["b"][i].as_buffer(), np.uint16), np.frombuffer(got["w"][i].as_buffer(), np.float32)) for i in order]  # nothing is copied
    model = fit(samples, [got["label"][i].as_py() for i in order])
    del got, samples
    give_back()
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, texts in with_made(batches):
            yield pa.RecordBatch.from_arrays([names, pa.array([z.tobytes() for z in shared.value.logits(texts).astype(np.float32)], pa.binary())], ["label", "z"])

    got = back.select("id", "text", "label").mapInArrow(tidy(scored), "label string, z binary").toArrow().sort_by([("label", "ascending"), ("z", "ascending")])
    place = {x: i for i, x in enumerate(model.labels)} | {None: len(model.labels)}
    names = got["label"].to_pylist()
    known = [i for i, x in enumerate(names) if x in place]
    z = np.array([np.frombuffer(got["z"][i].as_buffer(), np.float32) for i in known], np.float64).reshape(len(known), len(place))
    give_back()
    return calibrate(model, z, np.array([place[names[i]] for i in known], np.int64), most_wrong)


def judged(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row: struct of the ``keep`` columns, lang_pred, score, accepted) of each document."""
    keep = docs.columns if keep is None else keep
    letter = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    inside = text in keep and docs.schema[text].dataType.simpleString() == "string"  # then the text travels once
    rows = docs.select(F.struct(*keep).alias("row"), letter.alias("letter"), *[F.col(text).cast("string").alias("text")] * (not inside))
    if model is None:
        return rows.select("row", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.labels, UND], object)
        for batch in batches:
            for b in pieces(with_body(batch, text) if inside else batch, "text"):
                best, score = m.predict(b.column(2))
                none = ~np.asarray(b.column(1))
                best[none], score[none] = len(m.labels), 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(~none & (score >= m.min_score))], ["row", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` with lang_pred, score and accepted (which replace columns of these names)."""
    return unpacked(judged(docs, model, text, keep), "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted."""
    return judged(docs, model, text).where("accepted").select("row.*")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1, which is no fold, for ids that are null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))
