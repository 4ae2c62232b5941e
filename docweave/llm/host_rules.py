"""Quality rules with host-level verdicts.

Each text is measured once; rule failures are summed by host; hosts' failure rates shrink towards a beta prior that is fitted to
all hosts by moments (the variance between hosts is what is left of the rates' variance once that of counting is taken off); and the
verdict is joined back to the documents. A host fails when the lower end of its rate's credible interval (``sure`` posterior
standard deviations below the shrunken rate) has more than ``worse`` times the odds of the prior's mean: it must be worse than
hosts at large, and proven so. Hosts that differ by chance alone all pass, however many of their documents fail.

The hosts are broadcast if their table is counted to be small; beyond, the join is a plain shuffled one, which Spark's adaptive execution
splits where one host is very frequent.

Defined cases: null text has no words (and so fails a rule); a null host gets no verdict; with fewer than three hosts the prior has a
strength of 100 documents; an empty table gives an empty result; repeated rows count each; extra columns are left alone. A
text is held whole by one worker: 64 MB of text takes it less than 1.1 GB (tested), and so in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .staging import small, staged
from .words import Words, per_text, pieces, span_hashes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


def repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    ordered = np.sort(keys)
    often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(often):
        return np.zeros(len(keys), bool)
    return often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys


def measure(text: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = Words(text)
    n = len(w.raw)
    chars, symbols = per_text(w.word & ((w.raw & 0xC0) != 0x80), w.offsets), per_text(SYMBOLS[w.raw], w.offsets)
    w.word = None  # a long text's flags are given back before the windows
    salt = np.uint64(0xA24BAED4963EE407)
    # Lines that hold a word; a line ends at \n or with its text.
    cut = np.zeros(n + 1, bool)
    cut[w.offsets] = True
    newline = w.raw == 10
    cut[1:] |= newline
    begins = np.flatnonzero(cut[:n])
    ends = np.append(begins[1:], n)
    ends -= newline[ends - 1] if n else 0
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
    begins, ends = begins[has_word], ends[has_word]
    line_text = np.searchsorted(w.offsets, begins, "right") - 1
    lines = span_hashes(w.raw, begins, ends) + line_text.astype(np.uint64) * salt
    first = np.unique(lines, return_index=True)[1]
    again = np.ones(len(lines), bool)
    again[first] = False
    dup_lines = np.bincount(line_text[again], minlength=len(text))
    del cut, newline, w.ends
    # Words inside windows that the text holds twice or more.
    keys, at = windows(w.hashes, w.first, WINDOW)
    keys += w.text_of_word()[at].astype(np.uint64) * salt
    repeated = at[repeats(keys)]
    del keys, at
    covered = np.zeros(len(w.hashes) + WINDOW, bool)
    for d in range(WINDOW):
        covered[repeated + d] = True
    return [w.counts(), chars, symbols, dup_lines, per_text(covered[: len(w.hashes)], w.first)]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str | Column = "source") -> DataFrame:
    """doc_id, host and the five measures."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(host) if isinstance(host, str) else host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in measure(b.column(2))]], ["doc_id", "host", *MEASURES])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def domain(url: Column) -> Column:
    """The host of a URL in lower case, without a leading ``www.``; null where there is none. For tables that have URLs."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def host_verdicts(rows: DataFrame, worse: float, sure: float) -> DataFrame:
    """(host, host_rate, host_failed) from rows with ``host`` and ``base_failed``. Four numbers of the prior reach the driver."""
    hosts = staged(rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    p = F.col("failed") / F.col("n")
    mean, var, inverse, count = hosts.agg(F.avg(p), F.var_samp(p), F.avg(1 / F.col("n")), F.count(F.lit(1))).first()
    mean = mean or 0.0
    between = (var or 0.0) - mean * (1 - mean) * (inverse or 0.0)
    strength = 100.0 if count < 3 else 1e6 if between <= 0 else min(1e6, max(1.0, mean * (1 - mean) / between - 1))
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    hosts = hosts.withColumn("rate", rate)
    low = F.col("rate") - sure * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return hosts.select("host", F.round("rate", 6).alias("host_rate"), (F.round(low * (1 - mean), 9) > F.round(worse * mean * (1 - low), 9)).alias("host_failed"))


def host_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str | Column = "source", min_words: int = 10, max_repeat_percent: int = 20, worse: float = 2.0, sure: float = 1.645) -> DataFrame:
    """The measures, base_failed, the host's shrunken failure rate, and kept. ``host``: a column, such as :func:`domain` of a URL."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = staged(measured(docs, text, doc_id, host).withColumn("base_failed", failed), "measures")
    hosts = staged(host_verdicts(rows, worse, sure), "verdicts")
    out = rows.join(small(hosts), "host", "left")
    return out.select("doc_id", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))
