"""Queries of retrieval evaluation. Two runs are compared: BM25, and the same without length normalisation ("Flat")."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.queries import TYPES
from ..operators import evaluation as E
from ..operators.lexical import B, K1, bm25_runs
from ..session import written
from .fixtures import ITEMS, QRELS, QUERIES as QS, bm25_sql, items, queries, relevance, table

METRICS = ["p_at_5", "p_at_10", "r_at_5", "r_at_10", "rr"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_runs(queries(spark, sf_dir), items(spark, sf_dir), {"BM25": (K1, B), "Flat": (K1, 0.0)})


def asked(spark: SparkSession, sf_dir: str, qrels: DataFrame) -> DataFrame:
    """Usable queries, once for each strategy, with a stand-in for their latency (ms): the length of their text."""
    ok, _, _ = E.check_set(queries(spark, sf_dir), qrels, items(spark, sf_dir))
    ms = F.length("text") * F.when(F.col("strategy") == "BM25", 1).otherwise(2)
    return ok.withColumn("strategy", F.explode(F.array(F.lit("BM25"), F.lit("Flat")))).select("strategy", "query_id", "query_type", ms.alias("ms"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every query of both runs, written once: relevance rows are found once, and the corpus is searched once for both strategies."""
    qrels = written(relevance(spark, sf_dir), "qrels")
    return written(E.per_query(runs(spark, sf_dir), qrels, asked(spark, sf_dir, qrels)), "scores")


_S = f"""{QS}, {ITEMS}, {QRELS}, {bm25_sql('ba')}, {bm25_sql('bf', b=0.0)}, runs AS (SELECT 'BM25' AS strategy, * FROM ba UNION ALL SELECT 'Flat', * FROM bf),
nr AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
aq AS (SELECT s AS strategy, query_id, query_type, CAST(length(text) * CASE s WHEN 'BM25' THEN 1 ELSE 2 END AS INTEGER) AS ms FROM queries SEMI JOIN nr USING (query_id), unnest(['BM25', 'Flat']) AS u(s)),
hit AS (SELECT r.*, q.item_id IS NOT NULL AS rel FROM runs r LEFT JOIN qrels q USING (query_id, item_id)),
ag AS (SELECT strategy, query_id, count(*) FILTER (rank <= 5) AS f5, count(*) FILTER (rank <= 10) AS f10, count(*) FILTER (rank <= 5 AND rel) AS h5, count(*) FILTER (rank <= 10 AND rel) AS h10, min(rank) FILTER (rel) AS first FROM hit GROUP BY ALL),
scores AS (SELECT strategy, query_id, query_type, ms, round(coalesce(h5 / nullif(f5, 0), 0), 6) AS p_at_5, round(coalesce(h10 / nullif(f10, 0), 0), 6) AS p_at_10, round(coalesce(h5 / n_rel, 0), 6) AS r_at_5, round(coalesce(h10 / n_rel, 0), 6) AS r_at_10,
  round(coalesce(1 / first, 0), 6) AS rr FROM aq LEFT JOIN ag USING (strategy, query_id) LEFT JOIN nr USING (query_id))"""


def s3(spark, sf_dir):
    """Relevance rows of which some name items that are not there."""
    q = relevance(spark, sf_dir).withColumn("item_id", F.when(F.col("query_id") % 4 == 0, -F.col("item_id") - 1).otherwise(F.col("item_id")))
    ok, without, dangling = E.check_set(queries(spark, sf_dir), q, items(spark, sf_dir))
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "query_id")
    return part(ok, "usable").unionAll(part(without, "without")).unionAll(part(dangling, "dangling"))


S3 = f"WITH {QS}, {QRELS} SELECT CASE WHEN query_id IN (SELECT query_id FROM qrels) THEN 'usable' ELSE 'without' END AS kind, query_id FROM queries UNION ALL SELECT 'dangling', query_id FROM qrels WHERE query_id % 4 = 0"


def _columns(*names: str):
    return lambda spark, sf_dir: scores(spark, sf_dir).select("strategy", "query_id", *names)


def _sql(*names: str) -> str:
    return f"WITH {_S} SELECT strategy, query_id, {', '.join(names)} FROM scores"


def e4(spark, sf_dir):
    """Nearest-rank percentiles of event values by type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(*[F.round(E.nearest_rank("value", p), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


E4 = "SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roll_up(scores(spark, sf_dir), METRICS)


def e5(spark, sf_dir):
    return rolled(spark, sf_dir)


_R = f"""{_S}, rolled AS (SELECT strategy, CASE WHEN grouping(query_type) = 1 THEN 'Overall' ELSE query_type END AS query_type, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)},
quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms, count(*) AS n FROM scores GROUP BY GROUPING SETS ((strategy, query_type), (strategy)))"""
E5 = f"WITH {_R} SELECT * FROM rolled"


def e6(spark, sf_dir):
    """The values of two event types as paired samples, by user."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    s = e.groupBy(F.col("event_type").alias("strategy"), (F.col("user_id") % 25).alias("query_id")).agg(F.round(F.avg("value"), 6).alias("v"))
    t = E.paired_t(s, "v", "view", "click")
    return t.select("a", "b", "n", "mean_difference", "t", "p", E.mark(F.col("p")).alias("mark"), "significant")


_D = """sc AS (SELECT event_type AS strategy, user_id % 25 AS query_id, round(avg(value), 6) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
d AS (SELECT x.v - y.v AS d FROM sc x JOIN sc y USING (query_id) WHERE x.strategy = 'view' AND y.strategy = 'click'),
g AS (SELECT count(*) AS n, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d)"""
def _p_sql(source: str, name: str = "pv", t: str = "t", df: str = "df") -> str:
    """Common table expressions that end in ``name``: ``source`` with p, the incomplete beta function as a power series and the library's log gamma."""
    return f"""{name}_a AS (SELECT *, abs({t}) AS t_, CAST({df} AS DOUBLE) AS df_, df_ / (df_ + t_ * t_) AS x0, x0 < (df_ / 2 + 1) / (df_ / 2 + 2.5) AS near FROM {source}),
{name}_b AS (SELECT *, CASE WHEN near THEN x0 ELSE 1 - x0 END AS x, CASE WHEN near THEN df_ / 2 ELSE 0.5::DOUBLE END AS a, CASE WHEN near THEN 0.5::DOUBLE ELSE df_ / 2 END AS b FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN x <= 0 THEN 0.0::DOUBLE WHEN df_ > 30 THEN NULL ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a * (1 + list_sum(list_transform(range(0, 600), lambda i: exp(lgamma(a + b + i + 1) - lgamma(a + b) - lgamma(a + i + 2) + lgamma(a + 1) + (i + 1) * ln(x))))) END AS part,
  1 / (1 + {E.ERF_P}::DOUBLE * t_ / sqrt(2.0)) AS et FROM {name}_b),
{name} AS (SELECT * EXCLUDE (t_, df_, x0, near, x, a, b, part, et), CASE WHEN df_ > 30 THEN 1 - (1 - ({' + '.join(f'({c}::DOUBLE) * pow(et, {i + 1})' for i, c in enumerate(E.ERF_A))}) * exp(-t_ * t_ / 2)) WHEN near THEN part ELSE 1 - part END AS p FROM {name}_c)"""


_MARK = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"
E6 = f"WITH {_D}, {_p_sql('(SELECT *, n - 1 AS df FROM g)')} SELECT 'view' AS a, 'click' AS b, n, round(mean, 6) AS mean_difference, round(t, 6) AS t, round(p, 6) AS p, {_MARK} AS mark, p < 0.05 AS significant FROM pv"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p values of t statistics from events, at real degrees of freedom, few and many."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 40).alias("t"), (1 + F.col("event_id") % 590 / F.lit(10.0)).alias("df"))
    return e.select("event_id", F.round(E.student_p(F.col("t"), F.col("df")), 6).alias("p"))


def e7(spark, sf_dir):
    return p_values(spark, sf_dir)


_E7 = _p_sql("(SELECT event_id, value / 40 AS t, 1 + (event_id % 590) / 10.0::DOUBLE AS df FROM events)")
E7 = f"WITH {_E7} SELECT event_id, round(p, 6) AS p FROM pv"


def e8(spark, sf_dir):
    return p_values(spark, sf_dir).select("event_id", E.mark(F.col("p")).alias("mark"))


E8 = f"WITH {_E7}, r AS (SELECT event_id, round(p, 6) AS p FROM pv) SELECT event_id, {_MARK} AS mark FROM r"


def e9(spark, sf_dir):
    """Change of each query's reciprocal rank and precision from one strategy to the other."""
    s = scores(spark, sf_dir)
    a, b = (s.where(F.col("strategy") == x).select("query_id", F.col("rr").alias(f"rr_{x}"), F.col("p_at_5").alias(f"p_{x}")) for x in ("Flat", "BM25"))
    return a.join(b.hint("merge"), "query_id").select("query_id", *[F.round(E.improvement(F.col(f"{m}_Flat"), F.col(f"{m}_BM25")), 6).alias(f"{m}_change") for m in ("rr", "p")])


E9 = f"""WITH {_S} SELECT query_id, {', '.join(f'round(CASE WHEN a.{m} = 0 THEN 0::DOUBLE ELSE (b.{m} - a.{m}) / a.{m} * 100 END, 6) AS {n}_change' for m, n in (('rr', 'rr'), ('p_at_5', 'p')))}
FROM scores a JOIN scores b USING (query_id) WHERE a.strategy = 'Flat' AND b.strategy = 'BM25'"""


def e10(spark, sf_dir):
    """Strategies against the baseline, with p and mark of their paired differences."""
    s = scores(spark, sf_dir)
    return E.comparison(E.roll_up(s, METRICS), E.paired_t(s, "p_at_5", "Flat", "BM25"), "BM25")


E10 = f"""WITH {_R}, o AS (SELECT * FROM rolled WHERE query_type = 'Overall'), b AS (SELECT p_at_5 AS base FROM o WHERE strategy = 'BM25'),
d AS (SELECT x.p_at_5 - y.p_at_5 AS d FROM scores x JOIN scores y USING (query_id) WHERE x.strategy = 'Flat' AND y.strategy = 'BM25'),
g AS (SELECT count(*) AS n, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM d HAVING count(*) >= 2), {_p_sql('(SELECT *, n - 1 AS df FROM g)')},
j AS (SELECT o.*, base, CASE WHEN strategy = 'Flat' THEN (SELECT round(p, 6) FROM pv) END AS p FROM o, b)
SELECT strategy, p_at_5, round(CASE WHEN base = 0 THEN 0 ELSE (p_at_5 - base) / base * 100 END, 6) AS change, p, {_MARK} AS mark, r_at_5, rr, p95_ms FROM j"""


def e11(spark, sf_dir):
    return E.trade_offs(rolled(spark, sf_dir), "BM25", "Flat")


E11 = f"""WITH {_R}, w AS (SELECT query_type, max(p_at_5) FILTER (strategy = 'BM25') AS pa, max(p_at_5) FILTER (strategy = 'Flat') AS pb, max(p95_ms) FILTER (strategy = 'BM25') AS ma, max(p95_ms) FILTER (strategy = 'Flat') AS mb FROM rolled GROUP BY query_type)
SELECT query_type, CASE WHEN pa > pb THEN 'BM25' WHEN pb > pa THEN 'Flat' END AS more_precise, round(CASE WHEN pa = pb OR least(pa, pb) = 0 THEN 0 ELSE (greatest(pa, pb) - least(pa, pb)) / least(pa, pb) * 100 END, 6)::DOUBLE AS by_percent,
  CASE WHEN ma < mb THEN 'BM25' WHEN mb < ma THEN 'Flat' END AS faster, round((greatest(ma, mb) - least(ma, mb)) / least(ma, mb) * 100, 6)::DOUBLE AS slower_by_percent FROM w"""


def e12(spark, sf_dir):
    q = queries(spark, sf_dir)
    kinds = q.select("query_type").distinct().select("query_type", F.lit(-1).cast("long").alias("query_id"))
    return kinds.unionAll(q.where(F.col("query_type") == TYPES[2]).select("query_type", "query_id"))


E12 = f"WITH {QS} SELECT DISTINCT query_type, -1 AS query_id FROM queries UNION ALL SELECT query_type, query_id FROM queries WHERE query_type = '{TYPES[2]}'"

QUERIES = {
    "s3_evaluation_set": s3, "e1_precision": _columns("p_at_5", "p_at_10"), "e2_recall": _columns("r_at_5", "r_at_10"), "e3_reciprocal_rank": _columns("rr"), "e4_percentiles": e4, "e5_roll_up": e5, "e6_paired_t": e6,
    "e7_student_p": e7, "e8_marks": e8, "e9_improvement": e9, "e10_comparison": e10, "e11_trade_offs": e11, "e12_query_types": e12,
}
ORACLE_SQL = {
    "s3_evaluation_set": S3, "e1_precision": _sql("p_at_5", "p_at_10"), "e2_recall": _sql("r_at_5", "r_at_10"), "e3_reciprocal_rank": _sql("rr"), "e4_percentiles": E4, "e5_roll_up": E5, "e6_paired_t": E6,
    "e7_student_p": E7, "e8_marks": E8, "e9_improvement": E9, "e10_comparison": E10, "e11_trade_offs": E11, "e12_query_types": E12,
}
