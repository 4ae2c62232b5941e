"""SimHash components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docweave.llm import simhash

from .test_operators_llm import WORD, corpus, lower, make


def fingerprint(text, shingle=3):
    ws = WORD.findall(lower(text or ""))
    parts = [" ".join(ws[i : i + shingle]) for i in range(max(len(ws) - shingle + 1, bool(ws)))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, prints):
    """Smallest id reachable, of (id, text) rows; links by comparing all pairs."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [least[root(i)] for i in range(len(rows))]


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, components(rows, prints))), key=repr)


def found(df, **options):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df, **options).collect()), key=repr)


def near_texts(seed=9, n=300):
    """Long texts with a few words changed: fingerprints that differ in few bits."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((5000 + i, " ".join(w)))
    return out


def test_hash_equals_library():
    rng = random.Random(2)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 4, 7, 8, 11, 15, 16, 23, 24, 31, 32, 33, 200]))) for _ in range(500)]
    ends = np.cumsum([len(s) for s in spans])
    got = simhash.xxh64(np.frombuffer(b"".join(spans), np.uint8), ends - [len(s) for s in spans], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


@pytest.mark.parametrize("step", [7, 1 << 18])
def test_fingerprints(step):
    texts = [t for _, t, *_ in corpus()] + ["Ä ß", "a" * 100 + " b c d"]
    assert simhash.fingerprints(pa.array(texts), step=step).tolist() == [fingerprint(t) for t in texts]
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


def test_every_near_pair_shares_a_list():
    """All choices of at most three positions that differ."""
    from itertools import combinations

    for n in range(4):
        for differ in combinations(range(8), n):
            assert any(not set(t) & set(differ) for t in simhash.TRIPLES)


@pytest.mark.parametrize("small, part", [(64, 8192), (0, 8192), (2, 5), (10_000, 8192)])
def test_components(spark, small, part):
    rows = [(i, t) for i, t, *_ in corpus()] + near_texts()
    assert found(make(spark, [(i, t, None, None) for i, t in rows]), small=small, part=part) == expected(rows)


def test_near_texts_are_a_test():
    prints = {fingerprint(t) for _, t in near_texts()}
    assert len(prints) > 20 and 1 < len(set(components(near_texts(), [fingerprint(t) for _, t in near_texts()]))) < len(prints)


def test_null_ids_carry_links(spark):
    """Ids 1 and 2 are linked through a text that has no id only."""
    prints = {t: fingerprint(t) for _, t in near_texts()}
    far = lambda a, b: bin(prints[a] ^ prints[b]).count("1")
    chain = next((a, b, c) for a in prints for b in prints if 0 < far(a, b) <= 3 for c in prints if 0 < far(b, c) <= 3 < far(a, c))
    for middle, want in ((None, {1: 1, 2: 1, None: 1}), (3, {1: 1, 2: 1, 3: 1})):
        out = simhash.simhash_components(make(spark, [(1, chain[0], None, None), (middle, chain[1], None, None), (2, chain[2], None, None)])).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == want
    lone = simhash.simhash_components(make(spark, [(None, "a b c", None, None), (1, "x y z w", None, None)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in lone} == {None: None, 1: 1}


def test_forest_spans_components():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 8).astype(np.uint64)
    nodes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 8).astype(np.uint64)) for _ in range(20)] + [rng.integers(0, 2**63, 100).astype(np.uint64)]))
    a, b = simhash.forest(nodes)
    assert all(bin(int(x) ^ int(y)).count("1") <= 3 for x, y in zip(a, b))
    whole = components([(i, None) for i in range(len(nodes))], [int(x) for x in nodes])
    assert len(a) == len(nodes) - len(set(whole))


def test_empty(spark):
    assert simhash.simhash_components(make(spark, [])).count() == 0


def test_texts_of_megabytes():
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "Gamma", "d"]) for _ in range(300_000))
    words = re.findall("[^ ]+", lower(text))
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprints(pa.array([text])).tolist() == [want]
