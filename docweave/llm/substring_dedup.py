"""Removal of long repeated spans through a compacted de Bruijn graph of words.

Edges are windows of ``k`` words. They are dealt by minimiser, as in BCALM 2 (Chikhi et al., 2016): consecutive windows of a text
that share their smallest ``m``-word hash (the anchor) form one run, a path of edges with its source coordinates. Spark
joins then compact and verify:
* an anchor that occurs once leads to no repeated window;
* an anchor whose occurrences all continue alike is a nonbranching path: its runs are repeated as a whole;
* any other anchor is a branching node: the windows of its runs are expanded from their source coordinates and matched one by one.
Marked runs and windows go back to their documents by coordinate, and covered words are removed. Windows are judged on the input.

Defined cases: null text has no words; a text of fewer than ``k`` words has no window; a window repeated inside one text
counts as repeated; repeated rows repeat each other; an id may occur with several texts (rows are keyed by id and text); an
empty table gives an empty result; extra columns are left alone. Windows are compared by 64-bit hashes, of which two
different kinds (of run or window, and of its anchor) must agree; ``rid``, which leads spans back to their rows, is one 64-bit hash of
id and text. Rows of one id and text share their spans, which are gathered as sets, so that N repeated rows cost N times one row. A text
is held whole by one worker: 64 MB of text takes it less than 1.1 GB (tested), and so in proportion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import prefilter, staged
from .words import PIECE, Words, mix, pieces, powers, windows

K, M = 35, 8
_SPAN_BASE = 0xCA5A826395121157
_SPAN_INVERSE = pow(_SPAN_BASE, -1, 1 << 64)


STEP = PIECE // 4  # words taken at a time


class Spans:
    """Hashes of arbitrary word spans of some texts."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.total = np.zeros(n + 1, np.uint64)
        for lo in range(0, n, STEP):
            part = mix(hashes[lo : lo + STEP]) * powers(_SPAN_BASE, min(STEP, n - lo)) * np.uint64(pow(_SPAN_BASE, lo, 1 << 64))
            self.total[lo + 1 : lo + 1 + len(part)] = np.cumsum(part) + self.total[lo]
        self.back = np.array([pow(_SPAN_INVERSE, lo, 1 << 64) for lo in range(0, n + 1, STEP)], np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(_SPAN_INVERSE, min(STEP, len(self.total)))[start % STEP] * self.back[start // STEP]
        return mix((self.total[end] - self.total[start]) * back + (end - start).astype(np.uint64))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each position that begins ``width`` values: where the smallest of them stands first; taken in steps."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(values) - width + 1, STEP):
        part = values[lo : lo + STEP + width - 1]
        at, have = np.arange(lo, lo + len(part)), 1
        while have < width:
            move = min(have, width - have)
            lower = part[move:] < part[:-move]
            part, at, have = np.where(lower, part[move:], part[:-move]), np.where(lower, at[move:], at[:-move]), have + move
        out.append(at)
    return np.concatenate(out)


def runs_of(w: Words, k: int, m: int) -> tuple[np.ndarray, ...]:
    """text, first window, number of windows, anchor and content hash of each run."""
    at = windows(w.hashes, w.first, k)[1]
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    mers = np.full(len(w.hashes), np.uint64(2**64 - 1))
    keys, mer_at = windows(w.hashes, w.first, m)
    mers[mer_at] = keys
    del keys, mer_at
    where = leftmost_minima(mers, k - m + 1)[at]
    begin = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    n, start, anchor = np.diff(np.append(begin, len(at))), at[begin], mers[where[begin]]
    del at, where, mers
    text = np.searchsorted(w.first, start, "right") - 1
    return text, start - w.first[text], n, anchor, Spans(w.hashes).of(start, start + n + k - 1)


def kept_words(w: Words, keep: np.ndarray) -> list[memoryview]:
    """Each text's kept words, joined by one space; put together in steps of about PIECE bytes (a longer word is a step of its own)."""
    chosen = np.flatnonzero(keep)
    ends = np.cumsum((w.ends - w.starts)[chosen] + 1)  # where each kept word and its space end
    joined, i = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8), 0
    while i < len(chosen):
        begin = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        starts, lengths = w.starts[chosen[i:j]], w.ends[chosen[i:j]] - w.starts[chosen[i:j]]
        order = np.arange(int(lengths.sum()))
        word = np.repeat(np.arange(j - i), lengths)
        joined[begin + order + word] = w.raw[order + (starts - np.cumsum(lengths) + lengths)[word]]
        i = j
    at = np.append(0, ends)[np.searchsorted(chosen, w.first)]
    whole = memoryview(joined)
    return [whole[i : max(i, j - 1)] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def digests(texts: list[memoryview]) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())


def scan(rows: DataFrame, k: int, m: int) -> DataFrame:
    """Two kinds of rows: for each text its n_words and digest (all kept), and for each run its coordinates and hashes."""
    names = ["rid", "doc_id", "n_words", "digest", "start", "n", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w = Words(b.column(2))
                none = lambda n, t=pa.int64(): pa.nulls(n, t)
                n = b.num_rows
                texts = [b.column(0), b.column(1), pa.array(w.counts(), pa.int64()), digests(kept_words(w, np.ones(len(w.starts), bool))), *[none(n)] * 4]
                yield pa.RecordBatch.from_arrays(texts, names)
                text, start, count, anchor, content = runs_of(w, k, m)
                r = len(text)
                runs = [b.column(0).take(pa.array(text)), none(r, b.column(1).type), none(r), none(r, pa.string()), pa.array(start), pa.array(count), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
                yield pa.RecordBatch.from_arrays(runs, names)

    return rows.mapInArrow(run, f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, digest string, start long, n long, anchor long, content long")


def expanded(texts: DataFrame, k: int) -> DataFrame:
    """(rid, at, window, anchor) for each window of the ``spans`` (start, n, anchor) of (rid, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w, rid, spans = Words(b.column(1)), np.asarray(b.column(0)), b.column(2)
                flat, per = spans.flatten(), np.diff(np.asarray(spans.offsets))
                text = np.repeat(np.arange(len(per)), per)
                start, n, anchor = (np.asarray(x) for x in flat.flatten())
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - (np.cumsum(n) - n)[row] + start[row]
                first = at + w.first[text[row]]
                keys = Spans(w.hashes).of(first, first + k)
                yield pa.RecordBatch.from_arrays([pa.array(rid[text[row]]), pa.array(at), pa.array(keys.view(np.int64)), pa.array(anchor[row])], ["rid", "at", "window", "anchor"])

    return texts.select("rid", "text", "spans").mapInArrow(run, "rid long, at long, window long, anchor long")


def removed(texts: DataFrame, k: int, as_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 or kept_text) of (doc_id, text, spans); null spans remove nothing."""
    last = "kept_text" if as_text else "kept_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w, spans = Words(b.column(1)), b.column(2)
                flat, per = spans.flatten(), np.diff(np.asarray(spans.offsets))
                text = np.repeat(np.arange(len(per)), per)
                start, n = (np.asarray(x) for x in flat.flatten())
                begin = start + w.first[text]
                size = len(w.starts) + 1
                cover = np.bincount(begin, minlength=size) - np.bincount(begin + n + k - 1, minlength=size)
                keep = np.cumsum(cover)[: size - 1] == 0
                gone = np.zeros(size, np.int64)
                np.cumsum(~keep, out=gone[1:])
                kept = kept_words(w, keep)
                out = pa.array([str(x, "utf-8") for x in kept], pa.string()) if as_text else digests(kept)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts(), pa.int64()), pa.array(np.diff(gone[w.first])), out], ["doc_id", "n_words", "n_removed", last])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, {last} string")


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(doc_id), body).alias("rid"), F.col(doc_id).alias("doc_id"), body.alias("text"))


def repeated_spans(rows: DataFrame, scanned: DataFrame, k: int = K) -> DataFrame:
    """(rid, spans): the runs and windows of each text that occur elsewhere too, as (first window, number of windows)."""
    runs = scanned.where("start is not null").select("rid", "start", "n", "anchor", "content")
    nodes = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("c > 1")
    # Written out: a join of two plain shuffles is one that Spark can split where an anchor or a window is very frequent.
    nodes = staged(nodes.select("anchor", (F.col("lo") != F.col("hi")).alias("branching")), "nodes")
    found = staged(runs.drop("content").join(nodes.hint("merge"), "anchor"), "paths")

    branching = found.where("branching").groupBy("rid").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("spans"))
    branching = staged(branching, "branching")
    texts = prefilter(rows, "rid", branching.select("rid")).join(branching.hint("merge"), "rid")
    edges = staged(expanded(texts, k), "windows")
    often = staged(edges.groupBy("window", "anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("window", "anchor"), "often")
    windows_ = edges.join(often.hint("merge"), ["window", "anchor"]).select("rid", F.col("at").alias("start"), F.lit(1).cast("long").alias("n"))
    whole = found.where("not branching").select("rid", "start", "n")
    return whole.unionAll(windows_).groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = keyed(docs, text, doc_id)
    scanned = staged(scan(rows, k, m), "runs")
    spans = staged(repeated_spans(rows, scanned, k), "spans")
    cut = removed(prefilter(rows, "rid", spans.select("rid")).join(spans.hint("merge"), "rid"), k)
    whole = scanned.where("start is null").join(spans.select("rid").hint("merge"), "rid", "left_anti")
    return cut.unionAll(whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256")))


def kept_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text itself (words joined by one space) of every row."""
    rows = keyed(docs, text, doc_id)
    spans = repeated_spans(rows, staged(scan(rows, k, m), "runs"), k)
    return removed(rows.join(spans.hint("merge"), "rid", "left"), k, as_text=True)
