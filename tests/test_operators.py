"""Worked values and defined cases of the retrieval operators."""

import math
import os

import pytest
from pyspark.sql import functions as F

from docweave.functions import queries as Q
from docweave.functions import text as T
from docweave.operators import access, answers, chunking, cleaning, dense, evaluation, fusion, intake, lexical, reindex, store, usage
from docweave.sources import files
from docweave.streaming import jobs


def one(spark, text, step):
    return spark.createDataFrame([(text,)], "t string").select(step(F.col("t")).alias("x")).first()["x"]


def lists(spark, *rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "query_id int, rank int, item_id string, score double")


def test_reciprocal_rank(spark):
    out = fusion.reciprocal_rank(lists(spark, ("d1", 9.0), ("d2", 8.0)), lists(spark, ("d3", 9.0), ("d1", 8.0)))
    assert [(r["item_id"], round(r["score"], 5)) for r in out.orderBy("rank").collect()] == [("d1", 0.03252), ("d3", 0.01639), ("d2", 0.01613)]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank(out, constant=0)


def test_weighted(spark):
    b = lists(spark, ("a", 0.9), ("b", 0.8), ("c", 0.7))
    d = lists(spark, ("a", 0.95), ("b", 0.85), ("c", 0.75))
    assert [(r["item_id"], r["score"], r["origin"]) for r in fusion.weighted(b, d).orderBy("rank").collect()] == [("a", 0.975, "Hybrid"), ("b", 0.675, "Hybrid"), ("c", 0.375, "Hybrid")]
    flat = fusion.min_max(lists(spark, ("a", 0.5), ("b", 0.50005)))
    assert {r["score"] for r in flat.collect()} == {1.0}
    assert fusion.weighted(b.limit(0), d).count() == 3


def test_token_counts(spark):
    for n, tokens in ((0, 0), (4, 1), (5, 2), (8, 2)):
        assert one(spark, "x" * n, T.n_tokens) == tokens
    assert one(spark, None, T.n_tokens) == 0


def test_unicode(spark):
    assert one(spark, "é    ​x ‘a’ “b” –—", T.normalize_unicode) == "é     x 'a' \"b\" --"
    assert one(spark, None, T.normalize_unicode) is None


@pytest.mark.parametrize("text", ["", "a", "x" * 30 + "\n" + "y" * 31 + "\n" + "x" * 30 + " \nend", "\n\n", ("line of some length here\n" * 7) + "tail", "a\nb\na\nb"])
def test_repeated_lines(spark, text):
    def plain(t, threshold, least):
        lines, count, out, seen = t.split("\n"), {}, [], set()
        for x in lines:
            if len(x.strip()) >= least:
                count[x.strip()] = count.get(x.strip(), 0) + 1
        many = {k for k, n in count.items() if n >= threshold}
        if not many:
            return t
        for x in lines:
            k = x.strip()
            if k not in many or k not in seen:
                out.append(x + "\n")
            seen.add(k)
        return "".join(out)

    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    for threshold, least in ((2, 1), (3, 5), (2, 30)):
        want = plain(text, threshold, least)
        assert one(spark, text, lambda c: T.remove_repeated_lines(c, threshold, least)) == want  # noqa: B023
        assert cleaning.remove_repeated_lines(df, threshold=threshold, least=least).first()["cleaned"] == want


@pytest.mark.parametrize("n", [0, 1, 393, 394, 688, 689, 2000])
def test_chunks(spark, n):
    text = "  " + "".join(f"w{i}" + (" " if i % 7 else " \n") for i in range(n))
    df = spark.createDataFrame([("t", 1, text), ("t", 2, None), ("t", 3, "")], "tenant_id string, doc_id int, text string")
    got = chunking.chunk(df).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in got} == {1}
    words = text.split()
    starts = [0] if n <= 393 else list(range(0, n - 98, 295))
    assert [r["chunk_index"] for r in got] == list(range(len(starts)))
    for r, s in zip(got, starts):
        assert text[r["start_index"] : r["end_index"]] == r["text"]
        assert r["text"].split() == words[s : s + 393] and r["word_count"] == len(words[s : s + 393])
    assert chunking.chunk_errors(chunking.chunk(df)).count() == (1 if n == 0 else 0)
    with pytest.raises(ValueError):
        chunking.chunk(df, 100, 100)


def test_embedding_stage(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 100)], "i int, text string")
    out = chunking.embed(df, lambda ts: [[float(len(t)), float(len(ts) <= 32)] for t in ts], 2)
    assert out.where("embedding[0] <> i or embedding[1] <> 1").count() == 0
    with pytest.raises(Exception, match="vectors of 3"):
        chunking.embed(df, lambda ts: [[1.0]] * len(ts), 3).collect()


def test_queries(spark):
    assert one(spark, "  What  IS  x ", Q.normalize) == "what is x"
    assert one(spark, "why and how, then compare", Q.query_type) == "ImplicitFact"
    assert one(spark, "should I compare?", Q.query_type) == "InterpretableRationale"
    assert one(spark, " ", Q.query_type) == "ExplicitFact"
    assert [one(spark, x, Q.reply_type) for x in ("3", "Hidden", "??", None)] == ["InterpretableRationale", "HiddenRationale", "ExplicitFact", "ExplicitFact"]


def test_dense_search(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [-1.0, 0.0]), (4, "a", [1.0, 0.0, 0.0])], "item_id int, tenant_id string, embedding array<float>")
    q = spark.createDataFrame([(7, "a", [2.0, 0.0])], "query_id int, tenant_id string, embedding array<float>")
    assert [(r["item_id"], r["score"]) for r in dense.nearest(q, v).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert [r["item_id"] for r in dense.nearest(q, v, metric="euclid").orderBy("rank").collect()] == [1, 2, 3]
    assert [r["item_id"] for r in dense.nearest(q, v, by_tenant=True).orderBy("rank").collect()] == [1, 2]
    assert [(r["item_id"], r["score"]) for r in dense.dense(q, v).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]
    assert dense.nearest(q, v.limit(0)).count() == 0 and dense.nearest(q.limit(0), v).count() == 0


def test_bm25_by_hand(spark):
    items = spark.createDataFrame([(1, "a", "red red fox"), (2, "a", "blue fox"), (3, "b", None)], "item_id int, tenant_id string, text string")
    q = spark.createDataFrame([(1, "Red, fox!")], "query_id int, text string")
    got = {r["item_id"]: r["score"] for r in lexical.bm25(q, items).collect()}
    avg = 5 / 3
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    w = lambda tf, dl: tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == {1: round(idf(1) * w(2, 3) + idf(2) * w(1, 3), 6), 2: round(idf(2) * w(1, 2), 6)}


def test_context(spark):
    r = spark.createDataFrame([(1, "a", 0.9, "x" * 700, "s"), (1, "b", 0.8, "x" * 700, "s"), (1, "c", 0.5, "y" * 900, "s"), (1, "d", 0.1, "z", "s"), (2, "e", 0.1, "w", "s"), (2, "f", 0.2, "v", "s")], "query_id int, item_id string, score double, text string, source string")
    got = {x["query_id"]: x for x in answers.assemble(r, 400).collect()}
    assert got[2]["context"] == "[Source 1: s]\nv\n\n" and got[2]["n_sources"] == 1
    left = 360 - math.ceil((len("[Source 1: s]\n") + 702) / 4)
    assert got[1]["context"] == f"[Source 1: s]\n{'x' * 700}\n\n[Source 2: s]\n{('y' * 900)[: (left - min(left // 4, 15)) * 4]}...\n\n"


def test_citations_and_checks(spark):
    assert one(spark, "[source 3] [Source 1] [SOURCE  3] [Source 0] [Source 99999999999]", answers.cited) == [0, 1, 3]
    assert len(one(spark, "x" * 300, T.excerpt)) == 203
    rows = spark.createDataFrame([(1, "The cat sat. It purred! [Source 1]", "cat purred", "the cat sat near"), (2, " ", "q", "c"), (3, "Go", "go", " ")], "answer_id int, answer string, query string, context string")
    v = {r["answer_id"]: r for r in answers.validate(rows).collect()}
    assert v[1]["is_valid"] and v[1]["relevance_score"] == 1.0 and v[2]["issues"] == ["Response is empty or whitespace"]
    g = {r["answer_id"]: r for r in answers.ground(rows).collect()}
    assert set(g) == {1, 3} and g[3]["grounding_score"] == 0.0 and g[1]["n_claims"] == 3 - 1
    two = spark.createDataFrame([("blue sky", "the blue sky")], "c string, x string")
    assert two.select(answers.grounding(F.col("c"), F.col("x"))).first()[0] == 0.4


def test_prompts(spark):
    t = spark.createDataFrame([("Q {{Query}} {{other}}", "a$1\\b", None)], "t string, q string, n string")
    out = t.select(answers.render(F.col("t"), {"query": F.col("q"), "none": F.col("n")}).alias("x")).select("x", answers.leftovers(F.col("x")).alias("l")).first()
    assert out["x"] == "Q a$1\\b {{other}}" and out["l"] == ["other"]


def test_access(spark):
    docs = spark.createDataFrame([(1, "t", 10, False), (2, "t", 10, True)], "doc_id int, tenant_id string, owner_id int, is_public boolean")
    grants = spark.createDataFrame([(1, 11, 2, 10, 5)], "doc_id int, user_id int, permission int, granted_by int, granted_at int")
    admins = spark.createDataFrame([(99,)], "user_id int")
    ask = [(1, 10, "t", 3), (1, 11, "t", 2), (1, 11, "t", 3), (2, 12, "t", 1), (2, 12, "t", 2), (2, 10, "u", 1), (7, 10, "t", 1), (7, 99, "t", 3)]
    rows = access.decide(spark.createDataFrame(ask, "doc_id int, user_id int, tenant_id string, needed int"), docs, grants, admins).collect()
    got = {(r["doc_id"], r["user_id"], r["tenant_id"], r["needed"]): r["reason"] for r in rows}
    assert [got[x] for x in ask] == ["owner", "granted", "no permission", "public", "no permission", "other tenant", "not found", "admin"]
    after, bad = access.grant(grants, spark.createDataFrame([(1, 11, 1, 10, 6), (1, 10, 1, 12, 6), (1, 12, 9, 10, 6), (1, 10, 1, 10, 6)], grants.schema), docs)
    assert [r["permission"] for r in after.collect()] == [1] and bad.count() == 3


def test_significance(spark):
    def p(t, df):
        return spark.range(1).select(evaluation.student_p(F.lit(t), F.lit(df))).first()[0]

    def integral(t, df, n=20000):
        c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
        f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
        h = t / n
        return 1 - 2 * h * (f(0) / 2 + sum(f(i * h) for i in range(1, n)) + f(t) / 2)

    assert p(0.0, 3) == 1.0 and 0 < p(400.0, 29.5) < 1e-40
    for t, df in ((0.5, 1), (2.0, 2), (1.3, 3), (2.5, 8), (3.0, 29), (1.0, 30), (0.01, 1.5), (2.2, 7.25), (0.4, 29.9), (5.0, 12.5)):
        assert abs(p(t, df) - integral(t, df)) < 1e-6
    assert abs(p(1.96, 100) - 0.05) < 1e-3


def test_intake(spark):
    f = spark.createDataFrame([("a.txt", 5), ("a.pdf", 5), ("b", 0), ("../c.exe", 99)], "file_name string, length long")
    got = {r["file_name"]: (r["route"], len(r["errors"])) for r in intake.check_files(f, most=50).collect()}
    assert got == {"a.txt": ("accepted", 0), "a.pdf": ("unsupported", 0), "b": ("rejected", 1), "../c.exe": ("rejected", 3)}


def test_files_and_reindex(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("line\nother", encoding="utf-8")
    assert files.read_texts(spark, str(tmp_path / "in")).first()["text"] == "line\nother"
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "base.json").write_text('{"name": "base", "strategies": {"tableFormatting": {"enabled": true, "convertSeparators": true}, "repetitiveContent": {"enabled": true, "threshold": 3, "minimumLineLength": 20}}}')
    (rules / "more.json").write_text('{"name": "more", "enabled": true, "formArtifacts": ["Sig", "Sig"], "repetitiveContent": {"enabled": true, "threshold": 2, "minimumLineLength": 30}}')
    (rules / "off.json").write_text('{"name": "off", "enabled": false, "formArtifacts": ["x"]}')
    r = files.read_rules(spark, str(rules), ["base", "missing", "more", "off"])
    assert r.artifacts == ["Sig"] and r.repeated == (2, 30) and r.table == ", "
    with pytest.raises(ValueError):
        files.read_rules(spark, str(rules), ["off"])
    docs = spark.createDataFrame([("a", 1, "some words here"), ("b", 2, "others"), ("a", 3, " ")], "tenant_id string, doc_id int, text string")
    run = reindex.reindex(spark, docs, str(tmp_path / "index"), r, "a").first()
    assert (run["estimated"], run["processed"], run["status"]) == (2, 1, "Completed")
    reindex.reindex(spark, docs, str(tmp_path / "index"), r, "b")
    assert store.live_postings(spark, str(tmp_path / "index")).count() == 4
    es = tmp_path / "set.json"
    es.write_text('{"documents": [{"id": "d1", "text": "x", "source": "s"}], "queries": [{"id": "q1", "text": "t", "relevantDocIds": ["d1", "d9"], "queryType": "ExplicitFact"}, {"id": "q2", "text": "t", "relevantDocIds": []}]}')
    d, q, rel = files.read_evaluation_set(spark, str(es))
    ok, without, dangling = evaluation.check_set(q, rel, d)
    assert [ok.count(), without.count(), dangling.count()] == [1, 1, 1]


def test_streams(spark, tmp_path):
    up = tmp_path / "uploads"
    schema = "tenant_id string, doc_id int, text string, at timestamp"
    def add(rows):
        spark.createDataFrame(rows, "tenant_id string, doc_id int, text string, at string").selectExpr("tenant_id", "doc_id", "text", "cast(at as timestamp) at").coalesce(1).write.mode("append").parquet(str(up))

    add([("a", 1, "one text", "2024-01-01 00:00:00"), ("a", 2, "one text", "2024-01-01 00:00:01"), ("b", 3, "one text", "2024-01-01 00:00:02")])
    stream = lambda: spark.readStream.schema(schema).parquet(str(up))
    job = lambda: jobs.intake_job(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), cleaning.Rules()).trigger(availableNow=True).start()
    job().awaitTermination()
    add([("a", 4, "one text", "2024-01-01 00:05:00"), ("a", 5, "two", "2024-01-01 00:05:01")])
    job().awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()) == [1, 3, 5]
    found = lambda: sorted((r["tenant_id"], r["document_id"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out/hashes")).collect())
    assert found() == [("a", 1, 0), ("a", 5, 1), ("b", 3, 0)]
    # A batch whose commit is lost runs again, and changes nothing.
    (tmp_path / "ck/commits/1").unlink()
    (tmp_path / "ck/commits/.1.crc").unlink(missing_ok=True)
    job().awaitTermination()
    assert found() == [("a", 1, 0), ("a", 5, 1), ("b", 3, 0)]

    hashed = stream().withColumn("hash", intake.fingerprint(F.col("text")))
    q = jobs.distinct_uploads(hashed).writeStream.format("memory").queryName("distinct_uploads").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM distinct_uploads").count() == 3
    requests = stream().select(F.col("tenant_id").alias("client"), F.lit("e").alias("endpoint"), "at")
    q = jobs.quota_counts(requests, 1).writeStream.format("memory").queryName("quota").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["client"], r["n"]) for r in spark.sql("SELECT * FROM quota").collect()] == [("a", 2)]


def test_late_requests_are_counted(spark, tmp_path):
    schema = "client string, role string, endpoint string, at timestamp"
    limits = spark.createDataFrame([("user", "*", 5), ("user", "q", 1), ("admin", "*", 9)], "role string, endpoint string, quota int")
    out, stream = [], lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for times in (["00:00:10", "00:00:50", "00:01:01"], ["00:10:00"], ["00:10:03"], ["00:00:20", "00:10:01"], ["00:30:00"]):
        spark.createDataFrame([("c", "user", "q", f"2024-01-01 {t}") for t in times], "client string, role string, endpoint string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.quota_counts(stream(), limits).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["start"].minute, r["n"], r["quota"]) for r in out) == [(0, 2, 1), (10, 3, 1)] and jobs.late_rows(q) == 1


def test_adaptive_is_one_search_of_each_kind(spark):
    """What each route keeps equals its own search; each kind of search runs once."""
    words = ["what is ", "why ", "compare ", "should "]
    queries = spark.createDataFrame([(i, words[i % 4] + f"w{i} w{i + 1}") for i in range(24)], "query_id int, text string")
    calls = []

    def search(kind, step):
        def run(qs, k):
            calls.append(kind)
            rows = spark.createDataFrame([(q, r, (q * step + r * 3) % 40, round(1 / (r + step), 6)) for q in range(24) for r in range(1, 31)], "query_id int, rank int, item_id int, score double")
            return rows.where(F.col("rank") <= k).join(qs.select("query_id"), "query_id", "left_semi")

        return run

    got = fusion.adaptive(queries, search("lexical", 5), search("dense", 7), 6)
    found = {}
    for r in got.collect():
        found.setdefault(r["strategy"], set()).add((r["query_id"], r["rank"], r["item_id"], r["score"]))
    assert calls == ["lexical", "dense"] and set(found) == {"bm25", "dense", "hybrid"}
    routed, _ = fusion.route(queries)
    part = lambda s: routed.where(F.col("strategy") == s)
    rows = lambda df: {tuple(r) for r in df.select("query_id", "rank", "item_id", "score").collect()}
    assert found["bm25"] == rows(search("", 5)(part("bm25"), 6)) and found["dense"] == rows(search("", 7)(part("dense"), 6))
    assert found["hybrid"] == rows(fusion.weighted(search("", 5)(part("hybrid"), 20), search("", 7)(part("hybrid"), 20), k=6))


def test_rendering_by_template(spark):
    templates = spark.createDataFrame([("a", "v1", 1, "S {{X}}", "U {{y}} {{x}} {{z}} {{a.b}}"), ("a", "v2", 2, "T", "{{X}}{{x}}")], "name string, version string, loaded_at int, system_prompt string, user_prompt string")
    rows = [(1, "a", "V1", {"x": "$1\\\\", "Y": None, "a.b": "dot"}), (2, "a", None, {"x": "{{y}}", "y": "k"}), (3, "a", "none", {}), (4, "b", None, {"x": "1"})]
    r = spark.createDataFrame(rows, "query_id int, name string, version string, values map<string,string>")
    got = {x["query_id"]: (x["picked_version"], x["system_prompt"], x["user_prompt"]) for x in answers.render_prompts(r, templates).collect()}
    assert got == {1: ("v1", "S $1\\\\", "U  $1\\\\ {{z}} dot"), 2: ("v2", "T", "kk"), 3: (None, None, None), 4: (None, None, None)}


def test_comparison_without_a_baseline(spark):
    rolled = spark.createDataFrame([("A", "Overall", 0.5, 0.1, 0.2, 3)], "strategy string, query_type string, p_at_5 double, r_at_5 double, rr double, p95_ms int")
    tests = spark.createDataFrame([("A", 0.004)], "a string, p double")
    (row,) = evaluation.comparison(rolled, tests, "BM25").collect()
    assert row["change"] is None and (row["p"], row["mark"]) == (0.004, "**")


def test_quota_and_audit(spark):
    r = spark.createDataFrame([("c", "user", "q", "2024-01-01 00:00:10"), ("c", "user", "q", "2024-01-01 00:00:50"), ("c", "user", "q", "2024-01-01 00:01:01")], "client string, role string, endpoint string, at string").withColumn("at", F.col("at").cast("timestamp"))
    lim = spark.createDataFrame([("user", "*", 5), ("user", "q", 1)], "role string, endpoint string, quota int")
    assert [(x["n"], x["quota"]) for x in usage.over_quota(r, lim).collect()] == [(2, 1)]


def test_stored_index(spark, tmp_path):
    """The stored index answers as the corpus does, with few and many terms, whole and by tenant."""
    items = spark.createDataFrame([(i, f"t{i % 3}", " ".join(f"w{(i * k) % 17}" for k in range(i % 9))) for i in range(80)] + [(99, "t0", None)], "item_id long, tenant_id string, text string")
    queries = spark.createDataFrame([(1, "t0", "w1 w2 w2"), (2, "t1", "W3, w4!"), (3, "t2", "none"), (4, "t2", "")], "query_id long, tenant_id string, text string")
    lexical.write_index(items, str(tmp_path), buckets=8)
    got = lambda df: sorted(tuple(r) for r in df.collect())
    for by_tenant in (False, True):
        want = got(lexical.bm25(queries, items, 5, by_tenant=by_tenant))
        assert want and want == got(lexical.bm25_stored(queries, str(tmp_path), 5, by_tenant=by_tenant))
    own = got(lexical.bm25(queries, items, 5, by_tenant=True, stats_by_tenant=True))
    alone = [r for t in range(3) for r in got(lexical.bm25(queries.where(f"tenant_id = 't{t}'"), items.where(f"tenant_id = 't{t}'"), 5))]
    assert own == sorted(alone)


def test_dense_dealt_in_blocks(spark, monkeypatch):
    """Many queries in one job: blocks and parts give what one product gives; other dimensions and null vectors match nothing."""
    import numpy as np
    from docweave.operators import dense

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    items = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)] + [(900, [1.0]), (901, None)], "item_id long, embedding array<double>")
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    monkeypatch.setattr(dense, "BLOCK", 70)
    monkeypatch.setattr(dense, "PART", 40)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = np.argsort(-np.round(unit @ unit.T, 6), axis=1, kind="stable")[:, :3]
    got = {}
    for r in dense.nearest(queries, items, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items() if q < 900} == {q: best[q].tolist() for q in range(300)} and got[900] == [(1, 900)] and 901 not in got


def test_sinks(spark, tmp_path):
    """Vectors and results come back as they were written."""
    import json

    v = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0])], "item_id long, tenant_id string, embedding array<double>")
    files.write_vectors(v, str(tmp_path / "v"))
    files.write_vectors(v.where("item_id = 2").withColumn("item_id", F.lit(5).cast("long")), str(tmp_path / "v"))
    assert sorted((r["item_id"], r["tenant_id"], r["embedding"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [(1, "a", [1.0, 2.0]), (5, "b", [3.0])]
    names = ["p_at_5", "p_at_10", "r_at_5", "r_at_10", "rr"]
    rolled = spark.createDataFrame([("BM25", "Overall", 0.5, 0.25, 1.0, 1.0, 0.123456, 1, 2, 3, 7)], "strategy string, query_type string, " + ", ".join(f"{n} double" for n in names) + ", p50_ms int, p95_ms int, p99_ms int, n long")
    files.write_results(rolled, str(tmp_path / "r"), names)
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "r/csv")).collect()
    assert (row["p_at_5"], row["rr"], row["p95_ms"], row["n"]) == ("0.5000", "0.1235", "2.00", "7")
    (line,) = [x for f in (tmp_path / "r/json").glob("part-*") for x in f.read_text().splitlines()]
    assert json.loads(line)["precision"] == {"At5": 0.5, "At10": 0.25} and json.loads(line)["latency"]["p99_ms"] == 3


def test_finish_and_trim(spark):
    """The last cleaning step by hand: every line trimmed, one empty line at most in a row."""
    import re

    space = "[ \t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    texts = ["", " ", "a", "\n\n a \n\u3000\n\n b\t\nc  \n", "x\u00a0\n y", "a\n\nb", "a\n \n \nb \r\n c", "\x85a\x85"]

    def by_hand(t):
        t = re.sub(f"\n{space}*\n", "\n\n", re.sub(f"^{space}+|{space}+$", "", t))
        lines = [re.sub(f"^{space}+|{space}+$", "", x) for x in t.split("\n")]
        return "\n".join(x for i, x in enumerate(lines) if x or i == 0 or lines[i - 1])

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.finish(F.col("t"))).collect()
    assert [r[0] for r in got] == [by_hand(t) for t in texts]


def test_a_stored_index_does_not_repeat_ids(spark, tmp_path):
    """Postings name items by number: long ids take no room with every term, and ties are still broken by id."""
    rows = [(i, "t", " ".join(f"w{(i // 2 * k) % 97}" for k in range(60))) for i in range(200)]
    short = spark.createDataFrame(rows, "item_id long, tenant_id string, text string")
    long = short.withColumn("item_id", F.sha2(F.col("item_id").cast("string"), 256))
    size = {}
    for name, items in (("short", short), ("long", long)):
        lexical.write_index(items, f"{tmp_path}/{name}", buckets=4)
        size[name] = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{tmp_path}/{name}/postings") for f in fs)
    assert size["long"] < 1.2 * size["short"]
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5"), (3, "none")], "query_id long, text string")
    assert sorted(map(tuple, lexical.bm25_stored(q, f"{tmp_path}/long", 5).collect())) == sorted(map(tuple, lexical.bm25(q, long, 5).collect())) != []


def test_terms_counted_in_the_row(spark):
    d = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, None), (4, " - "), (5, "one")], "i long, text string")
    got = {r["i"]: {t["term"]: t["tf"] for t in r["t"]} for r in d.select("i", lexical.counted(F.col("text")).alias("t")).collect()}
    assert got == {1: {"a": 2, "b": 3, "c": 1}, 2: {}, 3: {}, 4: {}, 5: {"one": 1}}


def test_each_tenant_asks_every_query(spark):
    """The same rows as from queries multiplied with the tenants; items without a tenant count in the statistics only."""
    rows = [(i, f"t{i % 3}" if i % 7 else None, " ".join(f"w{(i * k) % 11}" for k in range(9))) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, tenant_id string, text string")
    q = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w5 none")], "query_id long, text string")
    asked = q.withColumn("tenant_id", F.explode(F.array(*[F.lit(f"t{t}") for t in range(3)]))).withColumn("query_id", F.concat("tenant_id", F.lit("-"), F.col("query_id").cast("string")))
    want = sorted(map(tuple, lexical.bm25(asked, items, 4, by_tenant=True).collect()))
    assert want and want == sorted((f"{t}-{i}", *r) for t, i, *r in map(tuple, lexical.bm25(q, items, 4, each_tenant=True).collect()))


def test_requests_are_not_dealt_by_template(spark):
    """Requests carry texts and have few names: they stay where they are."""
    r = spark.createDataFrame([(i, "en", None) for i in range(20)], "query_id long, name string, version string")
    t = spark.createDataFrame([("en", "v1", 1), ("en", "v2", 2)], "name string, version string, loaded_at long")
    out = answers.pick_versions(r, t)
    assert {x["picked_version"] for x in out.collect()} == {"v2"}
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_file_for_each_document(spark, tmp_path):
    """Each document is a file of its own and a row of its own, with line ends, empty or without a text."""
    from hashlib import md5

    from docweave.plans import jobs as plans

    texts = {1: "a\nb", 2: "", 3: None, 65: "\n", 129: "x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, plans.s1(spark, str(tmp_path)).collect()))
    assert got == [(i, md5(((t or "") + "\n").encode()).hexdigest(), len(t or "") + 1) for i, t in texts.items()]
