"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked token pairs.

Both tokenizers read a space and the text. The ends of their tokens, counted in bytes, are kept in dictionaries from end to index; the
intersection of the keys, sorted, slices both id lists into groups, and the links of each slice are all its pairs of an A and a B token.

Both cut before a single space or line feed between two characters that are not white space (A's pre-tokens begin there, and B has no
piece with a space after another character or with a line feed, which is checked). So texts are cut into such parts; those that a worker has not met yet are aligned
together, and what is known of a part is kept, in about ``CACHE_BYTES``, for all its occurrences.

A pair's count is the number of documents that hold it linked. At most ``frequent`` pairs, the ones of the highest counts, are joined
back by broadcast, the rest by shuffle: no key of that shuffle is in more documents than the pairs of the broadcast.

Defined cases: null and empty texts have no tokens, and so have texts that A's or B's tokens do not spell (U+2581 in them); repeated rows count
as documents of their own; an empty table gives an empty result; extra columns are left alone. Long texts are read in steps of
about 256,000 characters; a part without a single space is encoded whole. In a slice of many tokens ids are counted first, so that its
links take the product of its distinct ids and not of its tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .staging import staged, unpacked
from .token_counts import PATTERN
from .words import pieces

DEFAULT_A, DEFAULT_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of what a worker keeps; characters of texts that are read at a time; links of a slice beyond which its ids are counted first.
CACHE_BYTES, STEP, MANY_LINKS = 96 << 20, 1 << 18, 1 << 12
MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Bits of a B id in a pair, and of a pair in a key.
ID_BITS, PAIR_BITS = 18, 36


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def byte_ranks(path: str) -> dict[bytes, int]:
    """The ids of a byte-level BPE file by their bytes, without special tokens; its ids must follow its merges, so that they are ranks."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    table, vocab = byte_of_char(), file["model"]["vocab"]
    special = {t["content"] for t in file.get("added_tokens", ())}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
    if merged != sorted(merged) or max(vocab.values()) >> ID_BITS:
        raise ValueError(f"{path}: ids that do not follow the merges, or too many of them")
    return {bytes(table[c] for c in token): i for token, i in vocab.items() if token not in special}


def spelled_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece file; controls have none."""
    from sentencepiece import SentencePieceProcessor

    b = SentencePieceProcessor(model_file=path)
    out = []
    for i in range(b.get_piece_size()):
        name = b.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}|\n", name):
            raise ValueError(f"{path}: a piece has a space after another character, or a line feed, so that texts cannot be cut there")
        out.append(bytes([int(name[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else name.replace(MARK, " ").encode())
    return out


def steps(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """(number of the text, parts of a space and the text) of about STEP characters at a time; a long text goes over several steps."""
    work, size = [], 0
    for i, text in enumerate(texts):
        lo = 0
        while text and lo < len(text):
            cut = _CUT.search(text, lo + STEP - 1) if len(text) - lo > STEP else None
            hi = cut.start() if cut else len(text)
            work.append((i, _CUT.split(" " * (lo == 0) + text[lo:hi])))
            size, lo = size + hi - lo, hi
            if size >= STEP:
                yield work
                work, size = [], 0
    if work:
        yield work


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys)
    keys = keys[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cut], np.add.reduceat(times[order], cut)


def slice_links(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, how often each is linked, and their slices, in order; slices begin at from_x and have n_x tokens."""
    many = n_a * n_b > MANY_LINKS
    n = np.where(many, 0, n_a * n_b)
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    pair = a[from_a[of] + k // n_b[of]] << ID_BITS | b[from_b[of] + k % n_b[of]]
    if not many.any():
        return pair, np.ones(len(pair), np.int64), of
    parts = [(pair, np.ones(len(pair), np.int64), of)]
    for g in np.flatnonzero(many):
        (x, i), (y, j) = (np.unique(ids[lo : lo + m], return_counts=True) for ids, lo, m in ((a, from_a[g], n_a[g]), (b, from_b[g], n_b[g])))
        parts.append(((x[:, None] << ID_BITS | y).ravel(), (i[:, None] * j).ravel(), np.full(len(x) * len(y), g)))
    pair, times, of = map(np.concatenate, zip(*parts))
    order = np.argsort(of, kind="stable")
    return pair[order], times[order], of[order]


def put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from ``at`` on; grown by doubling."""
    if at + len(values) > len(array):
        array = np.concatenate([array, np.zeros(max(len(array), len(values)), array.dtype)])
    array[at : at + len(values)] = values
    return array


class Aligner:
    """Two tokenizers by the paths of their files, with what is known of the parts that were met."""

    def __init__(self, path_a: str = DEFAULT_A, path_b: str = DEFAULT_B):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        ranks = byte_ranks(path_a)
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = SentencePieceProcessor(model_file=path_b).encode
        self.bytes_a, self.bytes_b = [b""] * (max(ranks.values()) + 1), spelled_pieces(path_b)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        # How ids are written: inside a slice, then at the end of its side.
        self.written = [f"{i}{c}".encode() for i in range(len(self.bytes_a)) for c in ",|"] + [f"{i}{c}".encode() for i in range(len(self.bytes_b)) for c in ",;"]
        self.lengths = np.array([len(x) for x in self.written], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.told: list[bytes | None] = []  # the groups of each known part as text; None if its tokens do not spell it
        self.numbers = np.zeros((1024, 3), np.int64)  # its A tokens, B tokens and groups
        self.ends = np.zeros(1024, np.int64)  # where its links end
        self.pairs, self.times, self.n_pairs, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0, 0

    def store(self, parts: list[str], told: list[bytes | None], numbers: np.ndarray, ends: np.ndarray) -> None:
        k = len(self.told)
        self.known.update(zip(parts, range(k, k + len(parts))))
        self.told += told
        if k + len(parts) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros((max(k, len(parts)), 3), np.int64)])
        self.numbers[k : k + len(parts)] = numbers
        self.ends = put(self.ends, k, ends)
        self.used += 300 * len(parts) + sum(map(len, parts)) + sum(len(t or b"") for t in told)

    def learn(self, parts: list[str]) -> None:
        """Encode and align distinct new parts, as one text (which begins with a part of its own if the first one has no space)."""
        new, parts = parts, [" a"] * (parts[0][0] != " ") + parts
        text = "".join(parts)
        a, b, raw = self.a(text), self.b(text[1:]), text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            if len(new) == 1:
                self.store(new, [None], np.zeros((1, 3), np.int64), np.array([self.n_pairs]))
            else:
                self.learn(new[: len(new) // 2])
                self.learn(new[len(new) // 2 :])
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        index_a, index_b = (dict(zip(np.cumsum(size[x]).tolist(), range(len(x)))) for size, x in ((self.sizes_a, a), (self.sizes_b, b)))
        common = sorted(index_a.keys() & index_b.keys())
        last_a, last_b = (np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (index_a, index_b))
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        pair, times, of = slice_links(a, b, last_a + 1 - n_a, last_b + 1 - n_b, n_a, n_b)
        # Slices as text: the A ids of each, then its B ids.
        spelled = np.empty(len(a) + len(b), np.int64)
        of_a, of_b = np.repeat(np.arange(len(common)), n_a), np.repeat(np.arange(len(common)), n_b)
        spelled[np.arange(len(a)) + (last_b + 1 - n_b)[of_a]] = 2 * a + (np.arange(len(a)) == last_a[of_a])
        spelled[np.arange(len(b)) + (last_a + 1)[of_b]] = 2 * (len(self.bytes_a) + b) + (np.arange(len(b)) == last_b[of_b])
        told = b"".join(map(self.written.__getitem__, spelled.tolist()))
        written = np.append(0, np.cumsum(self.lengths[spelled]))
        # The last slice of each part.
        last = np.searchsorted(common, np.cumsum([len(p.encode()) for p in parts]))
        up_to = np.stack([last_a[last], last_b[last], last]) + 1
        cuts = np.append(0, written[up_to[0] + up_to[1]]).tolist()
        ends = self.n_pairs + np.searchsorted(of, last, "right")
        self.pairs, self.times = put(self.pairs, self.n_pairs, pair), put(self.times, self.n_pairs, times)
        self.n_pairs, self.used = self.n_pairs + len(pair), self.used + 16 * len(pair)
        self.store(parts, [told[lo : hi - 1] for lo, hi in zip(cuts, cuts[1:])], np.diff(up_to, prepend=0, axis=1).T, ends)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups) and the hash of the groups of each text; keys (number of the text << PAIR_BITS | pair), sorted, and how often each is linked."""
        numbers, good = np.zeros((len(texts), 3), np.int64), np.ones(len(texts), bool)
        hashes: dict = {}
        links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for work in steps(texts):
            if self.used > CACHE_BYTES:
                self.forget()
            new = set().union(*[parts for _, parts in work]).difference(self.known)
            loose = [p for p in new if p[1:2].isspace() or p[-1].isspace()]  # at the begin or end of a text; they cannot be joined
            for part in loose:
                self.learn([part])
            if new := list(new.difference(loose)):
                self.learn(new)
            rows = [list(map(self.known.__getitem__, parts)) for _, parts in work]
            for (i, _), ks in zip(work, rows):
                told = list(map(self.told.__getitem__, ks))
                if None in told:
                    good[i] = False
                    continue
                if i in hashes:
                    hashes[i].update(b";")
                else:
                    hashes[i] = hashlib.sha256()
                hashes[i].update(b";".join(told))
            k, of = np.fromiter(chain.from_iterable(rows), np.int64), np.repeat([i for i, _ in work], [len(ks) for ks in rows])
            np.add.at(numbers, of, self.numbers[k])
            begin = np.where(k > 0, self.ends[k - 1], 0)
            n = self.ends[k] - begin
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            links.append(summed(np.repeat(of, n) << PAIR_BITS | self.pairs[at], self.times[at]))
        keys, times = summed(*map(np.concatenate, zip(*links))) if len(links) > 2 else links[-1]
        whole = good[keys >> PAIR_BITS]
        return numbers * good[:, None], [hashes[i].hexdigest() if good[i] and i in hashes else "" for i in range(len(texts))], keys[whole], times[whole]


def aligned(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path_a: str = DEFAULT_A, path_b: str = DEFAULT_B) -> DataFrame:
    """row (struct of the ``keep`` columns), n_a, n_b, n_groups, groups_sha256, n_links, pairs (A id << ID_BITS | B id), times (links of each pair)."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for b in pieces(batch, "text"):
                numbers, hashes, keys, times = aligner.align(b.column(1).to_pylist())
                at = np.searchsorted(keys, np.arange(b.num_rows + 1) << PAIR_BITS)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for v in (keys & (1 << PAIR_BITS) - 1, times)]
                n_links = np.diff(np.append(0, np.cumsum(times))[at])
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(numbers[:, c]) for c in range(3)], pa.array(hashes, pa.string()), pa.array(n_links), *lists], ["row", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "pairs", "times"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, pairs array<long>, times array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether n is the highest of its A id)."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_a = W.partitionBy(F.shiftright("pair", ID_BITS))  # at most B's vocabulary
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def alignment(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path_a: str = DEFAULT_A, path_b: str = DEFAULT_B, frequent: int = 200_000) -> DataFrame:
    """The ``keep`` columns of ``docs`` with n_a, n_b, n_groups, n_links, n_best (links whose pair has its A id's highest count), count_sum
    (counts of all links) and groups_sha256."""
    rows = aligned(docs, text, keep, path_a, path_b).withColumn("at", F.monotonically_increasing_id())
    found = staged(rows, "aligned")
    counts = staged(pair_counts(found), "pair-counts")
    top = staged(counts.orderBy(F.desc("n"), "pair").limit(frequent), "frequent-pairs")
    rest = staged(counts.join(F.broadcast(top.select("pair")), "pair", "left_anti"), "other-pairs")

    links = found.select("at", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("at", "link.pairs", "link.times").withColumnRenamed("pairs", "pair")
    near = links.join(F.broadcast(top), "pair", "left")
    sums = (F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    if rest.isEmpty():
        both = near.groupBy("at").agg(*sums)
    else:
        far = links.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(rest.hint("merge"), "pair")
        both = near.groupBy("at").agg(*sums).unionAll(far.groupBy("at").agg(*sums)).groupBy("at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = found.select("at", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both.hint("merge"), "at", "left")
    out = out.withColumn("n_best", F.coalesce("n_best", zero)).withColumn("count_sum", F.coalesce("count_sum", zero))
    return unpacked(out, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
