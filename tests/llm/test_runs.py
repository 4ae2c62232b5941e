"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docweave.llm import entries, runs

from .test_operators_llm import WORD, corpus, make


def brute(w):
    """(start, length, period): every period is tried from every start, in order."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = p
        while i < n:
            if w[i] != w[i - p]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - p]:
                j += 1
            s, size = i - p, j - i + p
            if size >= max(6, 4 * p) and not any(all(w[k] == w[k - q] for k in range(s + q, s + size)) for q in range(1, p)):
                out.append((s, size, p))
            i = j
    return sorted(out)


def spin(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def expected(doc_id, text):
    w = spin(doc_id, WORD.findall(text or ""))
    rs = brute(w)
    drop = {i for s, n, p in rs for i in range(s + p, s + n)}
    best = min(rs, key=lambda r: (-r[1], r[0], r[2])) if rs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(rs), *best, 1000 * best[1] // best[2] if rs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in rs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))


def repetitive(rng, most_word=9):
    v, w = rng.choice([1, 2, 2, 3, 5, 20]), []
    for _ in range(rng.randint(0, 12)):
        if rng.random() < 0.4:
            w += [rng.randrange(v) for _ in range(rng.randint(1, 9))]
        else:
            u = [rng.randrange(v) for _ in range(rng.randint(1, most_word))]
            w += u * rng.randint(2, 8) + u[: rng.randrange(len(u))]
    return w


@pytest.mark.parametrize("most_word, n", [(9, 1500), (40, 200)])
def test_runs(most_word, n):
    rng = random.Random(most_word)
    for _ in range(n // 50):
        texts = [repetitive(rng, most_word) for _ in range(50)]
        first = np.cumsum([0, *map(len, texts)])
        assert runs.runs(np.array([x for t in texts for x in t], np.uint64), first) == [brute(t) for t in texts]


def test_runs_of_a_level_that_overlap():
    w = [0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1, 1, 0]
    assert runs.runs(np.array(w, np.uint64), np.array([0, len(w)]))[0] == brute(w) == [(6, 16, 4), (15, 21, 5)]


def test_squares_by_hand():
    """Every primitive square of abaabaab ends where it should."""
    w = [0, 1, 0, 0, 1, 0, 0, 1]
    want = set()
    for r in range(len(w)):
        for d in range(1, (r + 1) // 2 + 1):
            u = w[r - d + 1 : r + 1]
            primitive = not any(d % q == 0 and u == u[:q] * (d // q) for q in range(1, d))
            if primitive and u == w[r - 2 * d + 1 : r - d + 1]:
                want.add((r, d))
    assert set(runs.squares(w)) == want


def test_automaton():
    """States are sets of ends: links and lengths against all substrings."""
    rng = random.Random(1)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        length, link, ends = runs.automaton(w)
        assert [length[e] for e in ends] == list(range(1, len(w) + 1))
        at = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                at.setdefault(tuple(w[i:j]), set()).add(j)
        assert len(set(map(frozenset, at.values()))) == len(length) - 2
        for n, e in enumerate(ends, 1):
            if link[e] > 1:
                u = tuple(w[n - length[link[e]] : n])
                assert at[u] != {n} and at[tuple(w[n - length[link[e]] - 1 : n])] == at[tuple(w[:n])]


def test_frames(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t, *_ in corpus()] + [(2000 + i, " ".join(f"w{x}" for x in repetitive(rng, 30))) for i in range(120)] + [(None, "a b " * 9), (7, "x " * 6), (7, "x " * 6)]
    out = runs.periodic_runs(make(spark, [(i, t, None, None) for i, t in rows]), keep=["doc_id"], spin=True)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, want = sorted(map(tuple, out.collect()), key=repr), sorted((expected(i, t) for i, t in rows), key=repr)
    assert got == want and sum(r[1] > 0 for r in got) > 40
    kept = runs.periodic_runs(make(spark, [(1, "one", None, None)]))
    assert set(kept.columns) >= {"digest", "row", "text"} and kept.first()["n_runs"] == 0


def test_whole_query(spark, data):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 8000}
    got = {r["doc_id"]: tuple(r) for r in entries.op12_periodic_runs(spark, data).collect()}
    assert all(got[i] == expected(i, t) for i, t in rows.items())


def test_empty_and_long(spark):
    assert runs.periodic_runs(make(spark, []), keep=["doc_id"]).count() == 0
    n = 200_000
    words = np.arange(n, dtype=np.uint64) % np.uint64(7)
    words[::1000] = np.arange(n // 1000, dtype=np.uint64) + np.uint64(100)
    found = runs.runs(words, np.array([0, n]))[0]
    assert len(found) == n // 1000 and all(size == 999 and p == 7 for _, size, p in found)
    assert runs.runs(np.zeros(n, np.uint64), np.array([0, n])) == [[(0, n, 1)]]
