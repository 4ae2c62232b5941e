"""Training-data operators against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import components, entries, exact_dedup, extraction, host_rules, language, mixing, near_dedup, quality, sentencepieces, staging, substring_dedup, token_counts, words

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, score int, size int, key int, label string, _part int"


def make(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "r", "d", 1, 2, 3, "l", 4) for i, t, lang, s in rows], SCHEMA)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out, base = [], " ".join(rng.choice(vocab) for _ in range(120)).split()
    for i in range(n):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))
        if i % 5 == 0:
            t = t + "\n" + passage + " " + rng.choice(vocab)
        if i % 4 == 1:
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        if i % 11 == 0:
            t = out[-1][1] if out and out[-1][1] else "Same Text"
        if i % 13 == 0:
            t = (t or "x") .upper()
        out.append((i, t, "en", f"s{i % 3}" if i % 7 else "hot"))
    long = " ".join(rng.choice(vocab) for _ in range(6000))
    out += [(1000, None, None, None), (1001, "", "en", ""), (1002, " \n\t ", None, "s0"), (1003, long, "en", "s1"), (1004, "a a a a a a a a a a " * 8, "en", "s1"), (1005, "one", "en", "s2"), (1005, "one", "en", "s2"), (1006, "One", "en", None), (1007, "one two", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_word_hashes():
    texts = ["a b", None, "", "ab  c\n d", "b a", "x" * 3_000_000 + " y", "é é"]
    w = words.Words(pa.array(texts))
    assert w.counts().tolist() == [2, 0, 0, 3, 2, 2, 2]
    assert w.hashes[0] == w.hashes[6] and w.hashes[1] == w.hashes[5] and w.hashes[9] == w.hashes[10] and len(set(w.hashes.tolist())) == 8
    sliced = words.Words(pa.array(texts).slice(3, 2))
    assert sliced.hashes.tolist() == w.hashes[2:7].tolist()


def test_exact(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[lower(t)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g)
    for counters in (1024, 3):
        got = exact_dedup.exact_groups(docs, counters=counters)
        assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
        kept = exact_dedup.drop_copies(docs, counters=counters)
        assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, k, *_ in want if i == k)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_misra_gries_bound():
    rng = np.random.default_rng(0)
    values = [f"v{x}" for x in rng.zipf(1.5, 5000)]
    keys = {}
    for i in range(0, 5000, 500):
        keys = exact_dedup.misra_gries(keys, pa.array(values[i : i + 500]), 20)
    count = Counter(values)
    assert len(keys) <= 20 and all(k in keys for k, n in count.items() if n > 5000 / 21)
    assert all(n <= count[k] <= n + 5000 / 21 for k, n in keys.items())


def measures(t):
    ws = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cover = {p for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_host_rules(spark, empty):
    rows = corpus() + [(2000 + i, "one two three four five one two three four five #x|", "en", "bad") for i in range(80)] + [(3000, "l1 a\nl2\nl1 a\n \n \nl2 \n", "en", "good")]
    rows += [(4000 + i, " ".join(f"w{i}x{j}" for j in range(30)), "en", f"good{i % 6}") for i in range(240)]
    got = {r["doc_id"]: r for r in host_rules.host_rules(make(spark, rows)).collect()}
    for i, t, _, s in rows:
        m = measures(t)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m and r["base_failed"] == failed
        if s and s.startswith("good"):
            assert r["kept"] == (not failed)
        assert not (r["kept"] and failed)
    assert got[2000]["host_rate"] > 0.9 and host_rules.host_rules(empty).count() == 0


def test_host_verdicts(spark):
    """A host of failures takes its sound documents with it; small, chance and hostless ones stay."""
    bad, fine = "one two three four five " * 3, lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, bad if i % 50 == 0 else fine(i), "en", f"https://www.h{i % 10}.org/{i}") for i in range(2000)]
    rows += [(5000 + i, bad if i % 10 < 7 else fine(i), "en", f"http://WORSE.net/{i}") for i in range(100)]
    rows += [(6000, bad, "en", "http://tiny.org/x"), (6001, fine(1), "en", "http://tiny.org/y"), (6002, fine(2), "en", None), (6003, fine(3), "en", "no url")]
    got = {r["doc_id"]: r for r in host_rules.host_rules(make(spark, rows), host=host_rules.domain(F.col("source"))).collect()}
    assert all(got[i]["kept"] == (not got[i]["base_failed"]) for i in [*range(2000), 6000, 6001, 6002, 6003])
    lost = [i for i in range(5000, 5100) if not got[i]["kept"] and not got[i]["base_failed"]]
    assert len(lost) == 30 and got[6003]["host_rate"] is None
    assert [r[0] for r in spark.createDataFrame([("HTTP://WWW.A.org/x",), ("x",), (None,)], "u string").select(host_rules.domain(F.col("u"))).collect()] == ["a.org", None, None]


def test_mixing(docs, spark, empty):
    rows = {(r["row"]["doc_id"], i): r for i, r in enumerate(mixing.with_copies(docs).collect())}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows.values():
        s = r["row"]["source"]
        n = len(WORD.findall(r["row"]["text"] or ""))
        assert r["size"] == n and 0 <= r["copies"] <= 2
        sizes[s] += n
        taken[s] += n * r["copies"]
        target[s] = r["target"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_ = {}, set(names)
    while True:  # deal, cap, deal the excess again
        left = 1.5 * sum(sizes.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    for s in names:
        assert abs(goal[s] - target[s]) < 1e-3
        biggest = max(r["size"] for r in rows.values() if r["row"]["source"] == s)
        assert abs(taken[s] - target[s]) <= 2 * biggest
    again = Counter(r["doc_id"] for r in mixing.mix_rows(docs).collect())
    assert again == Counter(i for (i, _), r in rows.items() for _ in range(r["copies"])) and mixing.mix_rows(docs).columns == docs.columns
    assert mixing.mix_rows(empty).count() == 0


def test_mixing_is_native(docs):
    plan = mixing.with_copies(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def removed(texts, k=35):
    ws = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in ws for i in range(len(w) - k + 1))
    out = []
    for w in ws:
        cover = {p for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}
        out.append((len(w), len(cover), " ".join(x for p, x in enumerate(w) if p not in cover)))
    return out


def test_substring(docs, empty):
    rows = corpus()
    want = sorted((i, n, r, hashlib.sha256(s.encode()).hexdigest()) for (i, *_), (n, r, s) in zip(rows, removed([t for _, t, *_ in rows])))
    got = substring_dedup.substring_dedup(docs)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert any(r for _, _, r, _ in want)
    texts = substring_dedup.kept_texts(docs).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in texts) == sorted((i, s) for (i, *_), (_, _, s) in zip(rows, removed([t for _, t, *_ in rows])))
    assert substring_dedup.substring_dedup(empty).count() == 0


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(rows, k, percent):
    sets = [shingles(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)] if s else d, d == (least[find(i)] if s else d)) for i, ((d, *_), s) in enumerate(zip(rows, sets)))


def test_substring_of_many_equal_rows(spark):
    """Thousands of rows of one id and text: spans are gathered once, not once per row."""
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(400))
    rows = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = rows.unionAll(spark.createDataFrame([(8, "tail " + text), (9, "short")], "doc_id long, text string"))
    keyed = substring_dedup.keyed(rows, "text", "doc_id")
    spans = substring_dedup.repeated_spans(keyed, staging.staged(substring_dedup.scan(keyed, 35, 8), "runs"))
    assert max(r["n"] for r in spans.select(F.size("spans").alias("n")).collect()) <= 400 - 34
    got = substring_dedup.substring_dedup(rows).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in got) == [(7, 400, 400, 6000), (8, 401, 400, 1), (9, 1, 0, 1)]


@pytest.mark.parametrize(("k", "percent", "small", "block"), [(3, 85, 32, 512), (3, 85, 3, 4), (5, 80, 2, 3)])
def test_near(docs, empty, k, percent, small, block):
    got = near_dedup.near_components(docs, shingle=k, percent=percent, small=small, block=block)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == classes(corpus(), k, percent)
    if small == 32:
        kept = near_dedup.drop_near_copies(docs, shingle=k, percent=percent)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _, c, x in classes(corpus(), k, percent) if x}
        assert near_dedup.near_components(empty).count() == 0


def test_near_texts_without_ids_carry_links(spark):
    """A chain of near texts whose middle has no id is one component."""
    a = [f"w{i}" for i in range(200)]
    b, c = list(a), list(a)
    b[5] = c[5] = "x"
    c[150] = c[90] = "y"
    b[90] = "y"
    chain = [" ".join(w) for w in (a, b, c)]
    (_, _, mine, _), *_ = [x for x in classes([(1, chain[0]), (2, chain[2])], 3, 94) if x[0] == 2]
    assert mine == 2  # the ends are not linked themselves
    for middle in (None, 3):
        rows = [(1, chain[0], None, None), (middle, chain[1], None, None), (middle, chain[1], None, None), (2, chain[2], None, None), (None, "lone words of no id", None, None), (None, "", None, None)]
        got = [(r["doc_id"], r["component_id"]) for r in near_dedup.near_components(make(spark, rows), shingle=3, percent=94).collect()]
        assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (middle, 1), (middle, 1), (None, None), (None, None)], key=repr)


def test_near_large_group(spark):
    """Chains of edits: one component whose ends are far apart, in buckets that are too large for all pairs."""
    rng = random.Random(5)
    w = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        w = list(w)
        for _ in range(6):
            w[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    got = near_dedup.near_components(make(spark, rows), shingle=3, percent=85, small=4, block=16)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == classes(rows, 3, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_share_a_band(percent):
    """Recall of circulant bands, measured: 4,000 pairs of sets whose similarity is the threshold."""
    rng, size, n = np.random.default_rng(percent), 200, 4000
    common = -(-2 * size * percent // (100 + percent))
    keys = words.mix(rng.integers(0, 2**63, (n, 2 * size - common)).astype(np.uint64))
    left, right = np.sort(keys[:, :size], 1), np.sort(np.concatenate([keys[:, :common], keys[:, size:]], 1), 1)
    sig = [near_dedup.signatures(x.ravel(), np.arange(n + 1) * size) for x in (left, right)]
    height = near_dedup.band_rows(percent)
    agree = (sig[0] == sig[1]).reshape(n, height, -1).all(1).any(1)  # band b holds coordinates b, b + bands, ...
    assert agree.all()


def test_components_of_a_hub(spark):
    """Stars around two hubs that meet in one leaf, with a tail: hubs' edges are joined by broadcast."""
    edges = [(1, i) for i in range(1000, 4000)] + [(2, i) for i in range(3999, 6000)] + [(i, i + 1) for i in range(6000, 6040)] + [(7000, 7001)]
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in [1, 2, *range(1000, 6000)]) and all(got[i] == 6000 for i in range(6000, 6041)) and got[7001] == 7000 and len(got) == 5045


def test_circulant_signature():
    keys = words.mix(np.arange(3000, dtype=np.uint64))
    a, b = np.sort(keys[:2000]), np.sort(keys[500:2500])
    sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    assert (1 - 0.85 ** near_dedup.band_rows(85)) ** (near_dedup.COORDS // near_dedup.band_rows(85)) < 1e-6 and near_dedup.band_rows(85) == 5


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 600)]
    root = {x: x for p in pairs for x in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in pairs:
        root[max(find(x), find(y))] = min(find(x), find(y))
    got = components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


def test_language(spark, data, empty):
    d = spark.read.parquet(f"{data}/documents.parquet")
    held = language.fold(F.col("doc_id"), 5) == 0
    model = language.learn(d.where(~held), "text", "lang", "doc_id")
    got = language.identify(d.where(held), model).collect()
    assert np.isfinite(model.scores).all() and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert np.mean([r["accepted"] for r in got]) > 0.98 and np.mean([r["lang"] != r["lang_pred"] for r in got if r["accepted"]]) < 0.01
    rng = np.random.default_rng(1)
    noise = make(spark, [(i, language.without_language(r["text"], rng), None, None) for i, r in enumerate(got) if len(r["text"]) > 100])
    assert language.identify(noise, model).where("accepted").count() <= 0.1 * noise.count()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    odd = make(spark, [(1, None, None, None), (2, "", None, None), (3, "12 !?", None, None), (4, "a", None, None)])
    out = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] in model.labels and not out[1]["accepted"] and 0 <= out[4]["score"] <= 1
    assert language.accepted(odd, model).columns == odd.columns
    assert language.learn(empty, "text", "lang", "doc_id") is None and language.identify(odd, None).where("lang_pred = 'und'").count() == 4
    assert language.identify(empty, model).count() == 0


def test_rejection_threshold():
    score, wrong = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.5]), np.array([False, False, False, True, False, False])
    assert language.threshold(score, wrong, 0.2) == 0.5 and language.threshold(score, wrong, 0.17) == 0.5 and language.threshold(score, wrong, 0.1) == 0.8
    assert language.threshold(np.array([0.5]), np.array([True]), 0.1) > 0.5 and language.threshold(np.zeros(0), np.zeros(0, bool), 0.1) > 0


def test_error_bound():
    """The accepted share of errors is bounded with confidence, or the least bound is taken."""
    rng = np.random.default_rng(4)
    plain = language.LanguageModel(["a", "b"], np.zeros((1, 3)), np.zeros(3))
    z = np.zeros((4000, 3))
    z[np.arange(4000), rng.integers(0, 2, 4000)] = rng.uniform(0.2, 6, 4000)
    p = language.softmax(z)[:, :2]
    y = np.where(rng.random(4000) < p.max(1) ** 0.25, p.argmax(1), 2)
    m = language.calibrate(plain, z, y, 0.02)
    q = language.softmax(z / m.temperature)[:, :2]
    taken = q.max(1) >= m.min_score
    wrong = (q.argmax(1) != y)[taken].mean()
    assert wrong < m.error_bound <= 0.02 and 500 < taken.sum() < 4000
    few = language.calibrate(plain, z[:40], np.where(np.arange(40) == z[:40, 0].argmin(), 2, p[:40].argmax(1)), 0.001)
    assert 0.001 < few.error_bound < 0.2 and (language.softmax(z[:40] / few.temperature)[:, :2].max(1) >= few.min_score).sum() > 15
    assert language.calibrate(plain, z[:0], y[:0], 0.01) is plain


def test_fitted_predictions_by_hand(spark):
    """Folded bucket scores equal mean embedding times weights, and a query's training set is what its filter says."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd " if i % 2 else "wxyz ") for _ in range(rng.randint(5, 60))) for i in range(60)]
    names = ["p" if i % 2 else "q" for i in range(60)]
    m = language.fit(language.counted(pa.array(texts)), names)
    want = [sum(x * m.scores[b] for b, x in zip(*c)) + m.bias for c in language.counted(pa.array(texts))]
    assert np.allclose(m.logits(pa.array(texts)), want, atol=1e-4)
    best, score = m.predict(pa.array(texts))
    p = np.array([np.exp(w) / np.exp(w).sum() for w in want])[:, :2]
    assert [m.labels[i] for i in best] == names and np.allclose(score, p.max(1), atol=1e-4)
    d = make(spark, [(i, t, n, None) for i, (t, n) in enumerate(zip(texts, names))] + [(900 + i, t[::-1], "r", None) for i, t in enumerate(texts)])
    assert language.learn(d.where("doc_id < 900"), "text", "lang", "doc_id").labels == ["p", "q"]


def test_subwords_by_hand():
    """Buckets of all n-grams, counted by brute force, whatever the step."""

    def bucket(gram):
        h = (int.from_bytes(gram, "little") + (0x7F4A7C15 * len(gram) & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language.BITS)

    texts = [None, "", "a", " A,b ", "Fünf  Wörter – hier", "x" * 50, "日本 ab"]
    want = []
    for i, t in enumerate(texts):
        raw = bytes(c if c >= 128 or 97 <= c < 123 else 32 for c in (" " + (t or "") + " ").encode().translate(bytes(words.LOWER)))
        want += [(i, bucket(raw[j : j + n])) for n in language.ORDERS for j in range(len(raw) - n + 1) if raw[j : j + 2] != b"  "]
    for step in (5, 1 << 18):
        assert sorted((int(o), int(b)) for bs, os in language.subwords(pa.array(texts), step) for b, o in zip(bs, os)) == sorted(want)


def test_null_ids_are_in_no_fold(spark):
    d = make(spark, [(None, "a text", "en", None), (5, "b", "en", None)])
    assert [r[0] for r in d.select(language.fold(F.col("doc_id"), 3) == 1).collect()] == [False, zlib.crc32(b"5") % 3 == 1]


def test_language_survives_wrong_labels():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(20000)) if i % 2 else "".join(rng.choice("xyz ") for _ in range(30)) for i in range(200)]
    names = [("p" if i % 2 else "q") if i % 10 else "p" for i in range(200)]
    m = language.fit(language.counted(pa.array(texts)), names)
    assert np.isfinite(m.scores).all() and np.isfinite(m.bias).all()


def test_quality(spark, data, empty):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = language.fold(F.col("doc_id"), 3) == 1
    model = quality.learn(d, labels.where(~held))
    got = quality.score(d.join(labels, "doc_id").where(held), model).collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.85
    odd = make(spark, [(1, None, None, None), (2, "", None, None), (3, "x " * 50000, None, None)])
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect())
    none = quality.learn(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5} and quality.score(empty, model).count() == 0


def lexicon_by_hand(texts, most):
    """The most frequent items, counted one by one."""
    from collections import Counter

    seen = Counter(int(x) for t in texts for w, s, _ in quality.items(pa.array([t], pa.string())) for x in (*w.view(np.int64), *s.view(np.int64)))
    return quality.Lexicon(np.sort(np.array([i for i, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]], np.int64).view(np.uint64)))


def test_word_vectors_by_hand(spark):
    """The summed index vectors of all neighbours, word by word; a vector for each known word, pooling and network."""
    texts = [t for _, t, *_ in corpus()[:40]] + [None, "", "A a  a B!", "x"]
    rows = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(5)
    for most in (0, 30, 100000):
        lexicon = quality.lexicon_of(rows, most)
        assert np.array_equal(lexicon.known, lexicon_by_hand(texts, most).known)
        index, want = lexicon.index_vectors(), np.zeros((len(lexicon), quality.DIM))
        assert (np.abs(index).sum(1) >= 1).all() and set(np.unique(index)) <= {-1, 0, 1}
        for t in texts:
            word, shape, _ = quality.rows_of(pa.array([t], pa.string()), lexicon)
            for i in range(len(word)):
                for j in range(max(0, i - quality.NEAR), min(len(word), i + quality.NEAR + 1)):
                    if i != j:
                        for own in (word[i], shape[i]):
                            want[own] += index[word[j]].astype(float) + index[shape[j]]
        want /= np.maximum(1e-9, np.linalg.norm(want, axis=1, keepdims=True))
        vectors = quality.word_vectors(rows, lexicon)
        assert np.allclose(vectors, want, atol=1e-6)
    # With room for all items no two share a row, and a word's row is a shape's row never.
    words_, shapes = (np.concatenate([x[i] for t in texts for x in quality.items(pa.array([t], pa.string()))]) for i in (0, 1))
    assert len(np.unique(lexicon.rows(words_, False))) == len(np.unique(words_)) and not set(lexicon.rows(words_, False)) & set(lexicon.rows(shapes, True))
    # Pooling and network, text by text.
    rng = np.random.default_rng(1)
    layers = (rng.normal(size=120), rng.uniform(1, 2, 120), rng.normal(size=(120, 3)), rng.normal(size=3), rng.normal(size=3), 0.3, 1.7)
    got = quality.QualityModel(lexicon, vectors, layers, 0.5).score(pa.array(texts, pa.string()))
    for t, p in zip(texts, got):
        word, shape, _ = quality.rows_of(pa.array([t], pa.string()), lexicon)
        x = np.zeros(120)
        if len(word):
            v, s = vectors[word].astype(float), vectors[shape].astype(float)
            x = np.concatenate([v.mean(0), s.mean(0), vectors[sorted(set(word))].astype(float).mean(0), v.std(0), s.std(0)])
        out = sum(np.tanh(sum((x[i] - layers[0][i]) / layers[1][i] * layers[2][i, h] for i in range(120)) + layers[3][h]) * layers[4][h] for h in range(3)) + 0.3
        assert abs(p - 1 / (1 + np.exp(-out / 1.7))) < 1e-4


def test_long_texts_in_steps(monkeypatch):
    """Steps smaller than texts and words give the same items, contexts and pooled vectors."""
    rng = random.Random(9)
    texts = ["a a  b\n" * 9, None, "", "ü" * 40 + " a a", "   ", " ".join(rng.choice(["Aa", "b!", "b!", "ccc"]) for _ in range(70)), "x" * 33]
    column = pa.array(texts, pa.string())
    for limit in (1, 7, 16, 1000):
        got = list(words.parts(column, limit))
        joined = [""] * len(texts)
        for part, owner in got:
            for t, i in zip(part.to_pylist(), owner):
                joined[i] += t
        assert joined == [t or "" for t in texts]
        pieces_ = [t for part, _ in got for t in part.to_pylist()]
        assert [w for t in pieces_ for w in t.split()] == [w for t in texts if t for w in t.split()]
        assert all(len(t.encode()) <= limit or " " not in t[:-1].strip() for t in pieces_)
    lexicon = quality.Lexicon(np.zeros(0, np.uint64))
    whole = quality.rows_of(column, lexicon)
    vectors = np.random.default_rng(2).normal(size=(len(lexicon), quality.DIM)).astype(np.float32)
    want = quality.pooled(column, lexicon, vectors)
    monkeypatch.setattr(quality, "parts", lambda t: words.parts(t, 16))
    assert all(np.array_equal(a, b) for a, b in zip(whole, quality.rows_of(column, lexicon))) and len(whole[0])
    assert np.allclose(want, quality.pooled(column, lexicon, vectors))


def test_quality_learns():
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "today"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join([rng.choice(["cat", "sat"])] * 60) for _ in range(75)] + [" ".join(rng.choice(["CAT!!", "SAT!!", "ON!!"]) for _ in range(60)) for _ in range(75)]
    texts = pa.array(good + bad)
    lexicon = lexicon_by_hand(good + bad, 100)
    index = lexicon.index_vectors()
    word, shape, owner = quality.rows_of(texts, lexicon)
    around = quality.context(word, shape, owner, index)
    vectors = np.zeros((len(lexicon), quality.DIM), np.float32)
    np.add.at(vectors, word, around)
    np.add.at(vectors, shape, around)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    x, y = quality.pooled(texts, lexicon, vectors), np.array([1.0] * 150 + [0.0] * 150)
    layers = quality.fit(x[::2], y[::2])
    assert ((quality.probability(x[1::2], layers) > 0.5) == y[1::2]).mean() > 0.97


@pytest.fixture(scope="module")
def labeller(spark, data):
    return extraction.learn(spark.read.parquet(f"{data}/pages.parquet"))


def test_extraction(spark, data, labeller):
    from html import unescape

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in extraction.extract(pages, labeller).collect()}
    right = 0
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p|br)[^>]*>", inner))
        want = " ".join(x for x in parts if x)
        right += got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert right == len(got)


def test_extraction_of_other_pages(spark, labeller):
    body = "<p>" + "Plain words of an article stand here, and more of them follow. " * 4 + "</p>"
    html = f"""<!doctype html><html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p > a {{}}</style></head><body><!-- <p>c</p> -->
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>Caf&eacute; &amp; t<b>e</b>a</h1>{body}<p data-x="a>b">A &lt;b&gt; c&nbsp;d</p>{body}<form><label>Mail</label><input><button>Go</button></form></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=c>More</a></ul></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this.</p></div></section><footer><p>&copy; 2024</p></footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", ""), (4, "u", "<p>"), (5, "u", html * 20)], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in extraction.extract(rows, labeller).collect()}
    plain = " ".join(("Plain words of an article stand here, and more of them follow. " * 4).split())
    assert got[1]["text"] == f"Café & tea {plain} A <b> c d {plain}"
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and got[2]["n_chars"] == 0
    assert extraction.extract(rows.limit(0), labeller).count() == 0


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<html><head><meta charset=x><title>t</title><p>one<p>two", ["one", "two"]),
        ("<head><script>x<y</script><style>s</style><link rel=x>\n<div>one</div>", ["one"]),
        ("<head><title>t</title> one <p>two", ["one", "two"]),
        ("<html><head><title>t</title><template><p>no</p></template></head><body><p>one</body>", ["one"]),
        ("<p>area <math><mi>r</mi><mo>+</mo><mn>2</mn></math> here</p>", ["area r+2 here"]),
        ("<p>x <math><semantics><mi>r</mi><annotation encoding=t>\\r</annotation></semantics></math></p>", ["x r"]),
        ("<article><object data=x><p>fallback</p></object><svg><title>t</title><text>label</text></svg><p>end</p></article>", ["fallback", "label", "end"]),
        ("<article><svg/><p>end</p></article>", ["end"]),
    ],
)
def test_blocks_hold_all_shown_text(html, texts):
    assert [t for t, _, _ in extraction.blocks(html, {})] == texts


@pytest.mark.parametrize(
    "html, n",
    [
        ("<a " * 350_000, 1), ("<div>x" * 100_000, 100_000), ("<p>word</p>" * 100_000, 100_000), ('<a x="' + "<b>x" * 100_000, 1), ("<![CDATA[ " * 100_000, 1), ("<! " * 300_000, 1),
        ("<script></script " * 60_000, 1), ("<div>" * 100_000 + "x" + "</x>" * 100_000, 1), ("<td><div>" + "<b>" * 50_000 + "<td>x</td>" * 50_000, 50_000), ("<p>" + "x" * 5_000_000, 1), ("&#" * 400_000, 1),
    ],
)
def test_hostile_pages(html, n, labeller):
    import resource
    import time

    was, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    page = extraction.scan(html, {})
    labeller.keep([page, extraction.scan("<p>x</p>", {})])
    assert len(page[0]) == n and time.process_time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - was < 500_000


def test_steps_equal_paths(spark, data, labeller):
    """Path sums by steps label as flat paths do."""
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()] + ["<div class=a>x<p>y</div><b>z", ""]
    scans, flat = [extraction.scan(h, {}) for h in pages], [extraction.blocks(h, {}) for h in pages]
    for scan, page, kept in zip(scans, flat, labeller.keep(scans)):
        if page:
            a, b = labeller.inputs(extraction.packed([scan[0]], [scan[1]])), labeller.inputs(extraction.packed([page]))
            assert np.allclose(a, b, atol=1e-4)
            assert ((labeller.forward(extraction.packed([page]))[0][0] > 0) == kept).all()


def test_extraction_replaces_columns(spark, labeller):
    rows = spark.createDataFrame([(1, "<article><p>Plain words of an article stand here, and more follow.</p></article>", "r", "t", 5)], "page_id int, html string, row string, text string, n_chars int")
    out = extraction.extract(rows, labeller)
    assert sorted(out.columns) == ["n_chars", "page_id", "row", "text"] and out.first()["text"].startswith("Plain") and out.first()["row"] == "r"


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    net = extraction.Labeller.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = [[("some text", (1, 2), 0.0), ("more, of it", (3,), 1.0)], [("x", (2,), 0.5)]]
    b, y = extraction.packed(pages), np.array([[1.0, 0.0], [1.0, 0.0]])

    def loss():
        z, _ = net.forward(b)
        return float((np.logaddexp(0, np.where(y == 1, -z, z)) * b["mask"]).sum() / b["mask"].sum())

    g = net.gradients(b, y)
    for name in ("f", "b", "out", "f0"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.load()


def test_sentencepieces_equal_library(pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentencepieces.DEFAULT_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    for p, s in zip(proto.pieces, sentencepieces.zipf_scores([-p.score for p in proto.pieces])):
        p.score = s
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = [p.score for p in proto.pieces]
    texts = [t for _, t, *_ in corpus() if t is not None][:60] + ["", "a  b   c", "日本語 \U0001f600 x\r\n\ty", "The quick brown fox; don't jump.", "é" * 300, "word" * 400]
    for t, ids in zip(texts, pieces.encode(texts)):
        want = library.encode(t)
        assert ids.tolist() == want or (len(ids) == len(want) and abs(sum(score[i] for i in ids) - sum(score[i] for i in want)) < 1e-2), t[:50]
        assert pieces.decode(ids) == t


def test_normaliser_settings(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentencepieces.DEFAULT_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = False, True
    (tmp_path / "a.model").write_bytes(proto.SerializeToString())
    m = sentencepieces.load(str(tmp_path / "a.model"))
    assert [m.decode(x) for x in m.encode(["  a  b ", " ", "c"])] == ["a b", "", "c"]
    proto.normalizer_spec.precompiled_charsmap = b"x"
    (tmp_path / "b.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.load(str(tmp_path / "b.model"))


def test_piece_cache_is_bounded(monkeypatch, pieces):
    monkeypatch.setattr(sentencepieces, "CACHE_BYTES", 1000)
    want = pieces.encode(["one two three four five six seven"])[0].tolist()
    for i in range(50):
        assert pieces.encode([f"{i} one two three four five six seven " + "z" * 300])[0].tolist()[-3:] and pieces.encode(["one two three four five six seven"])[0].tolist() == want
    assert pieces.cached < 5000 and not any(len(u) > sentencepieces.LONG for u in pieces.cache)


def test_viterbi_forms_agree(pieces):
    units = [u for t in ("The quick brown \U0001f600fox", "aaaaabbb", "日本語x") for u in pieces.units(t)]
    raw = [u.replace(" ", sentencepieces.MARK).encode() for u in units]
    assert pieces.viterbi_many(raw) == [pieces.viterbi(r) for r in raw]


def test_double_array():
    keys = sorted({bytes(random.Random(i).choices(b"abcxyz\xc3\xa9", k=i % 7 + 1)) for i in range(400)})
    d = sentencepieces.DoubleArray.build(keys)
    for i, k in enumerate(keys):
        s = 0
        for c in k:
            assert d.check[d.base[s] + c] == s
            s = d.base[s] + c
        assert d.value[s] == i


def test_sentencepiece_frames(docs, empty, pieces):
    out = sentencepieces.encode(docs, pieces)
    assert out.where("not round_trip").count() == 0 and out.where("text is null and ids is not null").count() == 0
    back = sentencepieces.decode(out.select("doc_id", "text", "ids"), pieces)
    assert back.where("not (decoded <=> text)").count() == 0 and sentencepieces.encode(empty, pieces).count() == 0


def test_token_trees():
    counter, rng = token_counts.Counter(token_counts.ranks_of()), random.Random(9)
    full = lambda t: len(counter.encode(t))
    for _, t, *_ in corpus():
        text = t or ""
        tree = token_counts.TokenTree(text, counter)
        assert tree.n_tokens == full(text)
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 1, 7, 300, 5000])
            new = rng.choice(["", " ", "\n\n ", "x", "'s", "<redacted>", "     a", text[:500]])
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
            assert tree.text() == text and tree.n_tokens == full(text) and tree.n_chars == len(text)
    long = token_counts.TokenTree("word and more, " * 20000, counter)
    long.edit(150000, 150003, "zzz")
    assert long.encoded < 20


def test_token_frames(spark, docs, empty):
    ranks = token_counts.ranks_of()
    d = token_counts.edits_for(docs, "a+", "<x>")
    got = {r["doc_id"]: r for r in token_counts.count_edited(d, ranks).collect()}
    counter = token_counts.Counter(ranks)
    for i, t, *_ in corpus():
        r = got[i]
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) == (len(counter.encode(t or "")), len(re.findall("a+", t or "")), len(counter.encode(re.sub("a+", "<x>", t or ""))))
    assert token_counts.count_edited(token_counts.edits_for(empty, "a", "b"), ranks).count() == 0


def test_edits_of_other_digits(spark, tmp_path):
    texts = ["call \u0660\u0661\u0662\u0663\u0664", "\u0967\u0968\u0969\u096a now", "id \uff11\uff12\uff13\uff14 7", "id 1234", "a.b@c.de", "\u0660\u0661", "none"]
    make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_edits"] for r in entries.op2_token_counts(spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_prefilter(spark):
    rows, wanted = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7)
    out = {r["k"] for r in staging.prefilter(rows, "k", wanted).collect()}
    assert set(range(0, 5000, 7)) <= out and len(out) < 1500
    assert staging.prefilter(rows, "k", wanted.limit(0)).count() == 0


def test_without(spark):
    docs = spark.createDataFrame([(i, f"t{i % 3}", i) for i in range(3000)] + [(None, "t", 1)], "k long, text string, _map int")
    gone = spark.createDataFrame([(i, f"t{i % 2}") for i in range(0, 3000, 5)], "id long, t string")
    left = {r["k"] for r in staging.without(docs, gone, id=F.col("k"), t=F.col("text")).collect()}
    assert left == {None, *range(3000)} - {i for i in range(0, 3000, 5) if i % 3 == i % 2}
    assert staging.without(docs, gone.limit(0), id=F.col("k"), t=F.col("text")).count() == 3001 and staging.without(docs, gone, id=F.col("k"), t=F.col("text")).columns == docs.columns


def test_ties_of_one_id_are_ordered(spark):
    rows = [(7, "a b c", "en", "s"), (7, "a b d", "en", "s"), (7, "a b c", "en", "s"), (8, "x y z", "en", "s"), (None, "q q q", "en", "s")]
    runs = [sorted(str((r["row"]["text"], r["copies"])) for r in mixing.with_copies(make(spark, rows).repartition(n), share=0.7).collect()) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_steps_agree(monkeypatch):
    """Measures, runs, span hashes and kept words are the same whatever the size of a step, and as counted one by one."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "bb", "ü", "#x", "b\n", "a\n"], rng.integers(0, 300))) for _ in range(60)] + ["", None, "  ", "z" * 90]
    column, w = pa.array(texts, pa.string()), words.Words(pa.array(texts, pa.string()))
    keep = rng.random(len(w.starts)) < 0.6

    def all_of():
        v = words.Words(column)
        spans = substring_dedup.Spans(v.hashes).of(np.arange(400), np.arange(400) + np.arange(400) % 70)
        return [*substring_dedup.runs_of(v, 35, 8), *substring_dedup.runs_of(v, 9, 3), *host_rules.measure(column), *words.windows(v.hashes, v.first, 5), spans, np.array([bytes(x) for x in substring_dedup.kept_words(v, keep)], object)]

    want = all_of()
    for step in (40, 400):
        for module, name, value in ((words, "PIECE", step), (substring_dedup, "PIECE", step), (substring_dedup, "STEP", step // 4)):
            monkeypatch.setattr(module, name, value)
        assert all(np.array_equal(a, b) for a, b in zip(want, all_of(), strict=True))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    chosen = iter(keep)
    assert list(want[-1]) == [" ".join(x for x in s if next(chosen)).encode() for s in split]
    grams = [[tuple(s[i : i + 5]) for i in range(len(s) - 4)] for s in split]
    found = [{i + d for i, g in enumerate(x) if x.count(g) > 1 for d in range(5)} for x in grams]
    assert [len(f) for f in found] == list(want[14])


@pytest.mark.parametrize("name", ["op1", "op3", "op8", "op9"])
def test_memory_of_a_long_text(name):
    """A text of 64 MB takes a worker's step less than 1,100 MB, Python and libraries included."""
    import os
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
rng = np.random.default_rng(1)
pool = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(50000)]
text = pa.array([" ".join(pool[i] for i in rng.integers(0, 50000, 10_600_000))], pa.string())
assert 60e6 < text.nbytes < 72e6
from docweave.llm import host_rules, near_dedup, quality, substring_dedup as s, words
def op1():
    lexicon = quality.Lexicon(np.sort(rng.integers(0, 2**63, 49152).astype(np.uint64)))
    quality.pooled(text, lexicon, np.ones((len(lexicon), quality.DIM), np.float32))
def op3():
    host_rules.measure(text)
def op8():
    w = words.Words(text)
    s.kept_words(w, np.ones(len(w.starts), bool))
    s.runs_of(w, 35, 8)
def op9():
    near_dedup.signatures(*near_dedup.shingle_sets(text, 5))
""" + f"{name}()\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    peak = int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout)
    assert peak < 1100, peak
