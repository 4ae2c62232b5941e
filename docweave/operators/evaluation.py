"""Retrieval evaluation: metrics, roll-ups and significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import let

#: The coefficients of the public Lanczos sum for g = 7.
LANCZOS_G, LANCZOS_0 = 7.0, 0.99999999999980993
LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Abramowitz and Stegun 7.1.26, an error function by a polynomial of t = 1 / (1 + p x).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def check_set(queries: DataFrame, qrels: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable queries, queries without relevant documents, dangling relevance rows) of an evaluation set (query_id; query_id, item_id; item_id)."""
    dangling = qrels.join(documents.select("item_id").hint("merge"), "item_id", "left_anti")
    known = qrels.select("query_id").distinct()
    return queries.join(known.hint("merge"), "query_id", "left_semi"), queries.join(known.hint("merge"), "query_id", "left_anti"), dangling


def per_query(runs: DataFrame, qrels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """p_at_k, r_at_k (k in ``ks``) and rr of every query of every strategy.

    ``runs``: strategy, query_id, rank, item_id. ``qrels``: query_id, item_id. ``queries``: strategy, query_id: what was asked, so that
    queries without rows count. Precision divides by the rows found in the first k; recall by all relevant rows.
    """
    rel = qrels.distinct().withColumn("_rel", F.lit(True))
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = runs.join(rel.hint("merge"), ["query_id", "item_id"], "left").withColumn("_rel", F.coalesce("_rel", F.lit(False)))
    found = [F.count_if(F.col("rank") <= k).alias(f"_f{k}") for k in ks] + [F.count_if((F.col("rank") <= k) & F.col("_rel")).alias(f"_h{k}") for k in ks]
    g = hits.groupBy("strategy", "query_id").agg(*found, F.min(F.when(F.col("_rel"), F.col("rank"))).alias("_first"))
    rows = queries.join(g.hint("merge"), ["strategy", "query_id"], "left").join(n_rel.hint("merge"), "query_id", "left")
    share = lambda a, b: F.round(F.when(F.coalesce(b, F.lit(0)) > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0), 6)
    out = [share(F.col(f"_h{k}"), F.col(f"_f{k}")).alias(f"p_at_{k}") for k in ks] + [share(F.col(f"_h{k}"), F.col("_n")).alias(f"r_at_{k}") for k in ks]
    return rows.select(*queries.columns, *out, F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("rr"))


def nearest_rank(column: str, p: float) -> Column:
    """The nearest-rank percentile (no interpolation)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def roll_up(scores: DataFrame, metrics: list[str], ms: str = "ms") -> DataFrame:
    """Means, latency percentiles and counts by strategy and query type, and by strategy ("Overall")."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    ps = [nearest_rank(ms, p).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)]
    both = [[F.col("strategy"), F.col("query_type")], [F.col("strategy")]]
    rolled = scores.groupingSets(both, F.col("strategy"), F.col("query_type")).agg(F.grouping("query_type").alias("_all"), *means, *ps, F.count(F.lit(1)).alias("n"))
    return rolled.select("strategy", F.when(F.col("_all") == 1, "Overall").otherwise(F.col("query_type")).alias("query_type"), *metrics, "p50_ms", "p95_ms", "p99_ms", "n")


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = sum((a * F.pow(t, F.lit(i + 1)) for i, a in enumerate(ERF_A)), F.lit(0.0))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5 (Lanczos' sum)."""
    series = sum((c / (x + i) for i, c in enumerate(LANCZOS)), F.lit(LANCZOS_0))
    t = x + (LANCZOS_G - 0.5)
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(series)


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 60) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 < x < 1, by ``terms`` terms of its continued fraction, evaluated from the front (Lentz) on the
    side of x where it converges fast."""
    tiny = 1e-300  # keeps denominators off zero

    def body(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]

        def step(acc: Column, i: Column) -> Column:
            m = F.floor(i / 2)
            term = F.when(i % 2 == 0, m * (b - m) * x / ((a + i - 1) * (a + i))).otherwise(-(a + m) * (a + b + m) * x / ((a + i - 1) * (a + i)))
            # The product of all c and d lags one step, so that each of them is computed once.
            return F.struct((1 + term / acc["c"] + tiny).alias("c"), (1 / (1 + term * acc["d"] + tiny)).alias("d"), (acc["h"] * acc["c"] * acc["d"]).alias("h"))

        start = F.struct(F.lit(1.0).alias("c"), (1 / (1 - (a + b) * x / (a + 1) + tiny)).alias("d"), F.lit(1.0).alias("h"))
        fraction = let(F.aggregate(F.sequence(F.lit(2), F.lit(terms)), start, step), lambda acc: acc["h"] * acc["c"] * acc["d"])
        part = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a * fraction
        return F.when(v["near"], part).otherwise(1 - part)

    near = x < (a + 1) / (a + b + 2)
    swap = F.struct(F.when(near, x).otherwise(1 - x).alias("x"), F.when(near, a).otherwise(b).alias("a"), F.when(near, b).otherwise(a).alias("b"), near.alias("near"))
    return let(swap, body)


def student_p(t: Column, df: Column) -> Column:
    """Two-tailed p of |t| for real degrees of freedom: the normal distribution above 30, the incomplete beta function up to 30."""
    t, df = F.abs(t.cast("double")), df.cast("double")
    normal = 1 - erf(t / F.sqrt(F.lit(2.0)))
    exact = incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))
    return F.when(df > 30, normal).when(t == 0, 1.0).otherwise(exact)


def paired_t(scores: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """One row: n, mean difference (a - b), t, p, significant (p < 0.05), over queries that both strategies have; needs two pairs."""
    x = scores.where(F.col("strategy") == a).select("query_id", F.col(metric).alias("_a"))
    y = scores.where(F.col("strategy") == b).select("query_id", F.col(metric).alias("_b"))
    d = x.join(y.hint("merge"), "query_id").select((F.col("_a") - F.col("_b")).alias("d"))
    g = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    g = g.where("n >= 2").withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))
    g = g.withColumn("p", student_p(F.col("t"), F.col("n") - 1))
    return g.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n"), F.round("mean", 6).alias("mean_difference"), F.round("t", 6).alias("t"), F.round("p", 6).alias("p"), F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"))


def mark(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def improvement(a: Column, b: Column) -> Column:
    """Change from a to b in percent; 0 where a is 0."""
    return F.when(a == 0, 0.0).otherwise(F.try_divide(b - a, a) * 100)


def comparison(rolled: DataFrame, tests: DataFrame, baseline: str) -> DataFrame:
    """Each strategy against the baseline: p_at_5, change in percent, p, mark, r_at_5, rr, p95_ms. ``tests``: rows of :func:`paired_t` with the strategy as a."""
    overall = rolled.where("query_type = 'Overall'")
    base = overall.agg(F.max(F.when(F.col("strategy") == baseline, F.col("p_at_5"))).alias("_base"))  # one row, null without the baseline
    rows = overall.join(tests.select(F.col("a").alias("strategy"), "p").hint("merge"), "strategy", "left").crossJoin(F.broadcast(base))
    return rows.select("strategy", "p_at_5", F.round(improvement(F.col("_base"), F.col("p_at_5")), 6).alias("change"), "p", mark(F.col("p")).alias("mark"), "r_at_5", "rr", "p95_ms")


def trade_offs(rolled: DataFrame, a: str, b: str) -> DataFrame:
    """Per query type: which strategy is more precise and by what percent, and by what percent the slower one is slower."""
    w = rolled.groupBy("query_type").pivot("strategy", [a, b]).agg(F.first("p_at_5").alias("p"), F.first("p95_ms").alias("ms"))
    pa, pb, ma, mb = (F.col(f"`{s}_{m}`") for m in ("p", "ms") for s in (a, b))
    better = F.when(pa > pb, a).when(pb > pa, b)
    gain = F.when(pa > pb, improvement(pb, pa)).when(pb > pa, improvement(pa, pb)).otherwise(0.0)
    faster = F.when(ma < mb, a).when(mb < ma, b)
    slower = improvement(F.least(ma, mb), F.greatest(ma, mb))
    return w.select("query_type", better.alias("more_precise"), F.round(gain, 6).alias("by_percent"), faster.alias("faster"), F.round(slower, 6).alias("slower_by_percent"))
