"""Alignment of two tokenizers against whole texts encoded by their libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from docweave.llm import alignment

from .test_operators_llm import corpus, make


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.DEFAULT_A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.DEFAULT_B)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner()


def whole(libraries, aligner, text):
    """n_a, n_b, n_groups, hash, links by (A id, B id) of one text, encoded whole."""
    a, b = libraries
    xs, ys = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    bx, by = [aligner.bytes_a[i] for i in xs], [aligner.bytes_b[i] for i in ys]
    if not text or not (b"".join(bx) == b"".join(by) == (" " + text).encode()):
        return 0, 0, 0, "", {}
    groups, links, i, j, end_a, end_b = [([], [])], Counter(), 0, 0, 0, 0
    while i < len(xs) or j < len(ys):
        if end_a == end_b and i + j:
            groups.append(([], []))
        if end_a <= end_b:
            groups[-1][0].append(xs[i])
            end_a, i = end_a + len(bx[i]), i + 1
        else:
            groups[-1][1].append(ys[j])
            end_b, j = end_b + len(by[j]), j + 1
        if end_a > end_b and not groups[-1][1]:
            groups[-1][1].append(ys[j])
            end_b, j = end_b + len(by[j]), j + 1
    for x, y in groups:
        links.update((p, q) for p in x for q in y)
    told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return len(xs), len(ys), len(groups), hashlib.sha256(told.encode()).hexdigest(), dict(links)


ODD = ["a", "b", "the", " ", " ", "  ", "\n", "\t", " ", "　", "é", "中", "文", "😀", "<|endoftext|>", "<s>", "<0x41>", "'s", "1", "23", "!", "...", "́", "\x00", "\r\n", "\x85", "​", "x­b", "\x1c"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD + ["▁"] * (rng.random() < 0.02)) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("step, many, cache", [(1 << 18, 1 << 12, 1 << 26), (7, 3, 1 << 26), (50, 1 << 12, 2000)])
def test_texts(libraries, aligner, monkeypatch, step, many, cache):
    for name, value in (("STEP", step), ("MANY_LINKS", many), ("CACHE_BYTES", cache)):
        monkeypatch.setattr(alignment, name, value)
    aligner.forget()
    for texts in ([t for _, t, *_ in corpus()], odd_texts(1500), ["a" * 3000 + " " + "é" * 1000 + "​" * 700, " " * 2000 + "x" + "\n" * 900]):
        numbers, hashes, keys, times = aligner.align(texts)
        links = defaultdict(dict)
        for k, n in zip(keys.tolist(), times.tolist()):
            pair = k & (1 << alignment.PAIR_BITS) - 1
            links[k >> alignment.PAIR_BITS][pair >> alignment.ID_BITS, pair & (1 << alignment.ID_BITS) - 1] = n
        for i, t in enumerate(texts):
            assert (*numbers[i].tolist(), hashes[i], links[i]) == whole(libraries, aligner, t), t


@pytest.mark.parametrize("frequent", [200_000, 40, 0])
def test_frames(spark, libraries, aligner, frequent):
    rows = [(i, t) for i, t, *_ in corpus()] + [(3000 + i, t) for i, t in enumerate(odd_texts(100))] + [(None, "the the"), (1, "x▁y")]
    each = [whole(libraries, aligner, t) for _, t in rows]
    counts = Counter(p for x in each for p in x[4])
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = [(i, x[0], x[1], x[2], sum(x[4].values()), sum(n for p, n in x[4].items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in x[4].items()), x[3]) for (i, _), x in zip(rows, each)]
    out = alignment.alignment(make(spark, [(i, t, None, None) for i, t in rows]), keep=["doc_id"], frequent=frequent)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_empty_and_kept_columns(spark):
    assert alignment.alignment(make(spark, []), keep=["doc_id"]).count() == 0
    out = alignment.alignment(make(spark, [(1, "one two", None, None)]))
    assert set(out.columns) >= {"row", "digest", "text", "n_links"} and out.first()["n_groups"] == 2


def test_files_that_cannot_be_cut(tmp_path):
    import json

    with open(alignment.DEFAULT_A, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["merges"] = file["model"]["merges"][::-1]
    (tmp_path / "a.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        alignment.byte_ranks(str(tmp_path / "a.json"))
