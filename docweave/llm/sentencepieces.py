"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

A text is escaped (a space before it if the model's file says so, every space becomes U+2581) and segmented into the pieces with the largest sum of log scores.
Where no piece covers a character alone, the character can be an unknown piece (least score less 10), which is then
spelled in byte pieces. Piece files come from public tokenizers and are read once, on the driver; the tables (two trie
arrays, scores, bytes) have the size of the vocabulary and are broadcast. Files of the BPE kind hold merge ranks instead
of log scores: their pieces get the log of a Zipf share, -log(rank + 1) - log(sum of shares).

No piece has U+2581 after another character (checked), so that the best segmentation splits at words; white-space characters that no piece
holds split it too. Distinct units are encoded together, one trie step for all at a time; short ones are kept in a cache of
about ``CACHE_BYTES``.

Of a file's normaliser, the dummy prefix and the removal of extra white space are followed; a file with a character map is refused.

Defined cases: null text gives null ids, empty text no ids; long units are encoded whole; U+2581 in a text decodes as a space; other
texts come back unchanged from :func:`decode` (where the file removes extra white space, without it); repeated rows give equal
ids; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import unpacked
from .words import pieces as slices, tidy

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Bytes of a unit that is encoded alone and not kept; bytes of the cache, and of each of its entries beside text and ids.
LONG, CACHE_BYTES, ENTRY = 200, 1 << 25, 250
#: Text bytes that are encoded at a time (a longer text is taken alone, whole).
STEP = 1 << 18


@dataclass
class DoubleArray:
    """A trie of byte strings: from state s, byte c leads to t = base[s] + c if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes]) -> DoubleArray:
        tree: dict = {}
        for i, k in enumerate(keys):
            node = tree
            for c in k:
                node = node.setdefault(c, {})
            node[-1] = i
        base, check, value = [0] * 512, [-1] * 512, [-1] * 512
        check[0], free, top, queue = 0, 256, 256, [(0, tree)]
        for state, node in queue:
            value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while free < len(check) and check[free] >= 0:
                free += 1
            b = free - codes[0] if len(codes) == 1 else top - 64  # lone children fill the gaps
            if len(codes) > 1:
                while any(b + c < len(check) and check[b + c] >= 0 for c in codes):
                    b += 1
            for x, fill in ((base, 0), (check, -1), (value, -1)):
                x.extend([fill] * (b + 256 - len(x)))
            base[state] = b
            for c in codes:
                check[b + c] = state
                queue.append((b + c, node[c]))
            top = max(top, b + codes[-1])
        base, check, value = (np.array(x + [fill] * 256, np.int32) for x, fill in ((base, 0), (check, -1), (value, -1)))
        return cls(base, check, value)


@dataclass
class PieceModel:
    trie: DoubleArray
    ids: np.ndarray  # piece id of each trie value
    scores: np.ndarray  # log score of each trie value
    byte_ids: np.ndarray
    texts: list[bytes]  # what each id decodes to
    isolated: str  # white space that no piece holds
    split: bool
    prefix: bool = True
    squeeze: bool = False  # extra white space is removed
    cache: dict = field(default_factory=dict)
    cached: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "cached": 0}

    @property
    def unknown(self) -> np.float32:
        return np.float32(self.scores.min() - UNKNOWN_PENALTY)

    # Encoding

    def units(self, text: str) -> list[str]:
        """Parts whose best segmentations are independent; spaces stand for U+2581."""
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if not text:
            return []
        text = " " + text if self.prefix else text
        if not self.split:
            return [text]
        return _unit_pattern(self.isolated).findall(text)

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit; units of like length take their trie steps together."""
        raw = [u.replace(" ", MARK).encode("utf-8", "replace") for u in units]
        out: list = [None] * len(raw)
        short = sorted((i for i in range(len(raw)) if len(raw[i]) <= LONG), key=lambda i: len(raw[i]))
        for i in range(len(raw)):
            if len(raw[i]) > LONG:
                out[i] = self.spelled(self.viterbi(raw[i]), raw[i])
        for lo in range(0, len(short), 4096):
            part = short[lo : lo + 4096]
            for i, path in zip(part, self.viterbi_many([raw[i] for i in part])):
                out[i] = self.spelled(path, raw[i])
        return out

    def spelled(self, path: list[tuple[int, int]], raw: bytes) -> np.ndarray:
        """Ids of a path of (trie value or -1, begin)."""
        if all(v >= 0 for v, _ in path):
            return self.ids[[v for v, _ in path]]
        ends, out = [b for _, b in path[1:]] + [len(raw)], []
        for (v, begin), end in zip(path, ends):
            out += [self.ids[v]] if v >= 0 else self.byte_ids[list(raw[begin:end])].tolist()
        return np.array(out, np.int32)

    def viterbi_many(self, raw: list[bytes]) -> list[list[tuple[int, int]]]:
        n, width = len(raw), max(map(len, raw))
        lengths = np.array([len(r) for r in raw])
        chars = np.zeros((n, width + 1), np.int32)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        chars[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        best = np.full((n, width + 1), -np.inf, np.float32)
        best[:, 0] = 0
        origin, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (lengths > s))
            if not len(rows):
                continue
            lead = chars[rows, s]
            size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(n, bool)
            one = np.zeros(n, np.int32)
            one[rows] = size
            state, live, at = np.zeros(len(rows), np.int32), rows, s
            while len(live):
                c = chars[live, at]
                to = base[state] + c
                ok = (check[to] == state) & (lengths[live] > at)
                live, state, at = live[ok], to[ok], at + 1
                if not len(live):
                    break
                v = value[state]
                hit = v >= 0
                r, v = live[hit], v[hit]
                alone[r[one[r] == at - s]] = True
                total = best[r, s] + self.scores[v]
                better = total > best[r, at]
                r = r[better]
                best[r, at], origin[r, at], piece[r, at] = total[better], s, v[better]
            lost = ~alone[rows]
            r, end = rows[lost], np.minimum(s + size[lost], lengths[rows[lost]])
            total = best[r, s] + self.unknown
            better = total > best[r, end]
            r, end = r[better], end[better]
            best[r, end], origin[r, end], piece[r, end] = total[better], s, -1
        out: list = [[] for _ in raw]
        at, rows = lengths.copy(), np.flatnonzero(lengths > 0)
        while len(rows):
            p, o = piece[rows, at[rows]], origin[rows, at[rows]]
            for i, x, y in zip(rows.tolist(), p.tolist(), o.tolist()):
                out[i].append((x, y))
            at[rows] = o
            rows = rows[o > 0]
        return [path[::-1] for path in out]

    def viterbi(self, raw: bytes) -> list[tuple[int, int]]:
        """The same for one unit, position by position."""
        n = len(raw)
        best, back = np.full(n + 1, -np.inf, np.float32), [(-1, 0)] * (n + 1)
        best[0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(n):
            if best[s] == -np.inf:
                continue
            size = 1 if raw[s] < 0x80 else 2 if raw[s] < 0xE0 else 3 if raw[s] < 0xF0 else 4
            state, alone = 0, False
            for at in range(s, n):
                to = base[state] + raw[at]
                if check[to] != state:
                    break
                state = to
                if (v := value[state]) >= 0:
                    alone |= at + 1 - s == size
                    if (total := best[s] + self.scores[v]) > best[at + 1]:
                        best[at + 1], back[at + 1] = total, (int(v), s)
            if not alone and (total := best[s] + self.unknown) > best[end := min(n, s + size)]:
                best[end], back[end] = total, (-1, s)
        out, at = [], n
        while at:
            out.append(back[at])
            at = back[at][1]
        return out[::-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else self.units(t) for t in texts]
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        new, alone = [], {}
        for u in {u for us in split if us for u in us if u not in self.cache}:
            new.append(u)
            if len(u) > LONG:
                alone[u] = b""
        for u, ids in zip(new, self.encode_units(new)):
            coded = ids.astype(np.int32).tobytes()
            if u in alone:
                alone[u] = coded
            else:
                self.cache[u] = coded
                self.cached += ENTRY + len(u) + len(coded)
        get = (lambda u: self.cache[u] if u in self.cache else alone[u]) if alone else self.cache.__getitem__
        return [None if us is None else np.frombuffer(b"".join(map(get, us)), np.int32) for us in split]

    # Decoding

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_patterns: dict[str, re.Pattern] = {}


def _unit_pattern(isolated: str) -> re.Pattern:
    if isolated not in _patterns:
        x = re.escape(isolated)
        _patterns[isolated] = re.compile(f" *[^ {x}]+| +|[{x}]" if isolated else " *[^ ]+| +")
    return _patterns[isolated]


def from_pieces(names: list[str], scores: list[float], kinds: list[str], prefix: bool = True, squeeze: bool = False) -> PieceModel:
    """``kinds``: normal, byte, control or unknown for each piece. ``prefix``: a space goes before texts. ``squeeze``: extra spaces go."""
    normal = [i for i, k in enumerate(kinds) if k == "normal"]
    keys = [names[i].encode() for i in normal]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    byte_ids = np.zeros(256, np.int32)
    texts = []
    for i, (name, kind) in enumerate(zip(names, kinds)):
        if kind == "byte":
            byte_ids[int(name[3:5], 16)] = i
        texts.append(bytes([int(name[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else b" \xe2\x81\x87 " if kind == "unknown" else name.replace(MARK, " ").encode())
    held = set("".join(names[i] for i in normal))
    return PieceModel(
        DoubleArray.build([keys[i] for i in order]), np.array([normal[i] for i in order], np.int32), np.array([scores[normal[i]] for i in order], np.float32), byte_ids, texts,
        "".join(c for c in "\n\t\r\v\f" if c not in held), not any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in normal),
        prefix, squeeze,
    )


def zipf_scores(ranks: list[float]) -> list[float]:
    """Log shares of ranks from 0; ranks beyond the vocabulary count as its last."""
    r = np.minimum(np.array(ranks), len(ranks))
    share = 1 / (r + 1)
    return np.log(share / share.sum()).tolist()


def load(path: str = DEFAULT_MODEL, scores: str = "auto") -> PieceModel:
    """Read a SentencePiece model file. ``scores``: "file", "zipf" (of the file's ranks), or "auto" by the file's kind."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules = proto.normalizer_spec
    if rules.precompiled_charsmap or not rules.escape_whitespaces:
        raise ValueError(f"{path}: a character map of the normaliser, or spaces that are not escaped, cannot be followed")
    kind = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
    names, kinds = [p.piece for p in proto.pieces], [kind[p.type] for p in proto.pieces]
    given = [p.score for p in proto.pieces]
    if scores == "zipf" or scores == "auto" and proto.trainer_spec.model_type == 2:
        given = zipf_scores([-s for s in given])
    return from_pieces(names, given, kinds, rules.add_dummy_prefix, rules.remove_extra_whitespaces)


def encode(docs: DataFrame, model: PieceModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ids (array of int), n_pieces, n_byte_pieces and round_trip (ids decode to the text)."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        is_byte = np.zeros(len(m.texts), bool)
        is_byte[m.byte_ids] = True
        for batch in batches:
            for b in slices(batch, "text", STEP):
                texts = b.column(1).to_pylist()
                ids = m.encode(texts)
                flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
                counts = [0 if x is None else len(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum(counts)])
                none = np.array([x is None for x in ids])
                bytes_ = np.concatenate([[0], np.cumsum(is_byte[flat])])[offsets]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(none, False)), pa.array(flat))
                trip = [x is None or m.decode(x) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(counts, pa.int64()), pa.array(np.diff(bytes_), pa.int64()), pa.array(trip, pa.bool_())], ["row", "ids", "n_pieces", "n_byte_pieces", "round_trip"])

    out = rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")
    return unpacked(out, "ids", "n_pieces", "n_byte_pieces", "round_trip")


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(ids).alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.decode(None if x is None else np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", into])

    return unpacked(packed.mapInArrow(tidy(run), f"row {packed.schema['row'].dataType.simpleString()}, {into} string"), into)
