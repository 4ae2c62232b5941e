"""What the findings on cost changed: passes over the tables, and cheap forms of steps against the plain ones."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions.common import SPACE
from docweave.operators import lexical
from docweave.plans import fixtures, text


def test_rejects_clean_once(spark, data):
    plan = text.t9(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_cheap_forms_equal_plain_patterns(spark):
    rng = random.Random(1)
    signs = list(" \t\n\r\x0b\u0085  　  \n\n..,;:!?abZ9_ẹ́̀Å각Ж\U0001f600")
    df = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))),) for _ in range(2000)], "text string")
    c = F.col("text")
    blank = f"[{SPACE}&&[^\n]]"
    forms = [
        (T.no_space_before(c, "[,;:.!?]", SPACE), F.regexp_replace(c, f"{SPACE}+([,;:.!?])", "$1")),
        (T.no_space_before(F.rtrim(c, F.lit(T.BLANKS)), "\n", T.BLANK), F.regexp_replace(c, f"{blank}++(?=\n|\\z)", "")),
    ]
    for cheap, plain in forms:
        assert df.where(~cheap.eqNullSafe(plain)).count() == 0
    composed = df.select("text", T.nfc(c).alias("nfc")).collect()
    assert [r["nfc"] for r in composed] == [unicodedata.normalize("NFC", r["text"]) for r in composed]


def test_bm25_makes_no_row_for_each_pair(spark, data):
    plan = fixtures.lexical_results(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1


def test_blocks_of_scores_equal_brute_force(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "MOST_SCORES", 12)
    rng = random.Random(2)
    idf, avgdl, k = np.array([0.5, 1.0, 2.0, 0.1, 3.0]), 4.0, 2
    asked = sorted({(rng.randrange(7), rng.randrange(5)) for _ in range(20)})
    query, term, qtf = (np.array(x) for x in zip(*[(q, t, rng.randint(1, 2)) for q, t in asked]))
    items = [{"item_id": f"i{n:02}", "dl": 6, "terms": ts, "tfs": [1 + t % 2 for t in ts]} for n in range(30) for ts in [sorted(rng.sample(range(5), rng.randint(0, 3)))]]
    rng.shuffle(items)
    schema = pa.schema({"item_id": pa.string(), "dl": pa.int32(), "terms": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())})
    batch = pa.RecordBatch.from_pylist(items, schema)
    step = lexical.best_of_blocks(query, term, qtf, pa.array([f"q{q}" for q in range(7)]), idf, avgdl, {"a": (1.2, 0.75), "b": (1.2, 0.0)}, k)
    rows = [r for out in step(iter([batch])) for r in out.to_pylist()]
    for name, b in (("a", 0.75), ("b", 0.0)):
        for q in range(7):
            want = {}
            for i in items:
                for t, tf in zip(i["terms"], i["tfs"]):
                    for n in np.flatnonzero((query == q) & (term == t)):
                        want[i["item_id"]] = want.get(i["item_id"], 0) + qtf[n] * idf[t] * tf / (tf + 1.2 * (1 - b + b * i["dl"] / avgdl))
            best = sorted((-round(v, 9), i) for i, v in want.items())[:k]
            got = sorted((-round(r["score"], 9), r["item_id"]) for r in rows if r["strategy"] == name and r["query_id"] == f"q{q}")[:k]
            assert got == best
