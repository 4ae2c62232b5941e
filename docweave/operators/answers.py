"""Context assembly, citations, answer checks and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import SPACE, errors, is_blank, let, sized, trim_all
from ..functions.text import excerpt, n_tokens

MIN_SCORE, MAX_TOKENS, SAFE = 0.3, 3000, 0.9
CITATION = rf"(?i)\[Source{SPACE}+(\d+)\]"
#: Words that never count as keywords.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with what when where who which this these those can could should would do does"
).split()
RELEVANCE, GROUNDED = 0.3, 0.7
SENTENCE = f"(?<=[.!?]){SPACE}+(?=[A-Z])"


# Context


def relevant(results: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Rows with enough score, in order; the single best row of a query without any."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    rows = results.withColumn("rank", F.row_number().over(order))
    return rows.where((F.col("score") >= least) | (F.col("rank") == 1))


def distinct_texts(results: DataFrame) -> DataFrame:
    """The best row of each text of a query."""
    same = W.partitionBy("query_id", F.sha2("text", 256)).orderBy("rank")
    return results.withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn")


def pack(results: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(query_id, context, n_sources): blocks in order while their tokens fit 90 % of the limit; the first that does not fit is cut to
    what is left, if over 20 tokens, and ends the context."""
    limit = int(max_tokens * SAFE)
    order = W.partitionBy("query_id").orderBy("rank")
    rows = results.withColumn("n", F.row_number().over(order))
    block = F.concat(F.lit("[Source "), F.col("n").cast("string"), F.lit(": "), F.coalesce("source", F.lit("")), F.lit("]\n"))
    rows = rows.withColumn("head", block).withColumn("tokens", n_tokens(F.concat("head", "text", F.lit("\n\n"))))
    rows = rows.withColumn("sum", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    left = limit - (F.col("sum") - F.col("tokens"))
    cut = F.substring(F.col("text"), F.lit(1), ((left - F.least(F.floor(left / 4), F.lit(15))) * 4).cast("int"))
    part = F.when(F.col("sum") <= limit, F.concat("head", "text", F.lit("\n\n"))).when(left > 20, F.concat("head", cut, F.lit("...\n\n")))
    first_over = F.min(F.when(F.col("sum") > limit, F.col("n"))).over(W.partitionBy("query_id"))
    rows = rows.withColumn("part", part).withColumn("_over", first_over).where((F.col("_over").isNull() | (F.col("n") <= F.col("_over"))))
    parts = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("n", "part"))))
    return rows.groupBy("query_id").agg(parts.alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("context"), F.size("p").alias("n_sources"))


def assemble(results: DataFrame, max_tokens: int = MAX_TOKENS, least: float = MIN_SCORE, dedup: bool = True) -> DataFrame:
    rows = relevant(results, least)
    return pack(distinct_texts(rows) if dedup else rows, max_tokens)


# Citations


def cited(answer: Column) -> Column:
    """Distinct cited numbers in ascending order; null text has none."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    numbers = F.transform(found, lambda x: F.expr("1").cast("long") * 0 + F.try_to_number(x, F.lit("9999999999999999")).cast("long"))
    fits = F.filter(numbers, lambda x: x <= 2147483647)
    return F.coalesce(F.array_sort(F.array_distinct(fits)).cast("array<int>"), F.array().cast("array<int>"))


def citation_count(answer: Column) -> Column:
    return F.coalesce(F.regexp_count(answer, F.lit(CITATION)), F.lit(0))


def link_sources(answers: DataFrame, results: DataFrame, answer: str = "answer") -> DataFrame:
    """(query_id, number, source_id, title, excerpt, score) for each citation that has a row of that rank; others are skipped."""
    asked = answers.select("query_id", F.explode(cited(F.col(answer))).alias("rank"))
    rows = asked.join(results.hint("merge"), ["query_id", "rank"])
    return rows.select("query_id", F.col("rank").alias("number"), F.col("item_id").alias("source_id"), F.col("source").alias("title"), excerpt(F.col("text")).alias("excerpt"), "score")


# Checks


def keywords(query: Column) -> Column:
    words = F.transform(F.split(query, r"(?U)\W+"), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def relevance(answer: Column, query: Column) -> Column:
    """Share of the query's keywords that the answer holds; 0 without keywords."""
    low = F.lower(answer)
    share = let(keywords(query), lambda ks: F.when(F.size(ks) > 0, F.size(F.filter(ks, lambda k: F.contains(low, k))) / F.size(ks)))
    return F.when(is_blank(answer) | is_blank(query), 0.0).otherwise(F.coalesce(F.round(share, 6), F.lit(0.0)))


def validate(answers: DataFrame, answer: str = "answer", query: str = "query") -> DataFrame:
    """``answers`` with relevance_score, citation_count, issues and is_valid; a blank answer has that one issue."""
    a = F.col(answer)
    rows = answers.withColumn("relevance_score", relevance(a, F.col(query))).withColumn("citation_count", F.when(is_blank(a), 0).otherwise(citation_count(a)))
    low = F.concat(F.lit("Response may not be relevant to query (relevance score: "), F.format_string("%.2f", "relevance_score"), F.lit(")"))
    rest = errors((F.col("citation_count") == 0, "Response missing source citations in format [Source N]"), (F.col("relevance_score") < RELEVANCE, low))
    rows = rows.withColumn("issues", F.when(is_blank(a), F.array(F.lit("Response is empty or whitespace"))).otherwise(rest))
    return rows.withColumn("is_valid", F.size("issues") == 0)


def claims(answer: Column) -> Column:
    """Sentences, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(answer, SENTENCE), trim_all), lambda x: x != "")


def grounding(claim: Column, context: Column) -> Column:
    """0.6 x share of the claim's word triples found in the context + 0.4 x share of its pairs; claims of one word: share of words over
    two characters. N-grams match where their words stand one space apart."""
    low, text = F.lower(context), F.lower(claim)
    words = F.filter(F.split(text, r"[ \t\n\r.,!?]"), lambda w: w != "")

    def share(grams: Column) -> Column:
        return let(grams, lambda g: F.when(F.size(g) > 0, F.size(F.filter(g, lambda x: F.contains(low, x))) / F.size(g)).otherwise(0.0))

    def body(ws: Column) -> Column:
        grams = lambda n: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
        single = share(F.array_distinct(F.filter(ws, lambda w: F.length(w) > 2)))
        return F.when(F.size(ws) < 2, single).otherwise(share(grams(3)) * 0.6 + share(grams(2)) * 0.4)

    return F.round(let(words, body), 6)


def ground_claims(answers: DataFrame, answer: str = "answer", context: str = "context", key: str = "answer_id") -> DataFrame:
    """(key, position, claim, score, is_grounded); none for blank contexts."""
    rows = answers.where(~is_blank(F.col(context))).select(key, F.posexplode(claims(F.col(answer))).alias("position", "claim"), context)
    return rows.select(key, "position", "claim", grounding(F.col("claim"), F.col(context)).alias("score")).withColumn("is_grounded", F.col("score") >= GROUNDED)


def ground(answers: DataFrame, answer: str = "answer", context: str = "context", key: str = "answer_id", review_below: float | None = None, consistency: Column | None = None, faithfulness: Column | None = None) -> DataFrame:
    """One row per answer with text: grounding_score (mean of claims; 0 for blank contexts, 1 without claims), confidence (weights 0.5, 0.3,
    0.2 of the parts that are given), level, needs_review and issue."""
    scored = ground_claims(answers, answer, context, key).groupBy(key).agg(F.avg("score").alias("_s"), F.count(F.lit(1)).alias("n_claims"), F.count_if("is_grounded").alias("n_grounded"))
    rows = answers.where(~is_blank(F.col(answer))).join(scored.hint("merge"), key, "left")
    s = F.round(F.when(is_blank(F.col(context)), 0.0).otherwise(F.coalesce("_s", F.lit(1.0))), 6)
    parts = [(s, 0.5)] + [(c, w) for c, w in ((consistency, 0.3), (faithfulness, 0.2)) if c is not None]
    confidence = reduce(lambda a, b: a + b, [c * w for c, w in parts]) / sum(w for _, w in parts)
    rows = rows.withColumn("grounding_score", s).withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)), 6))
    level = F.when(F.col("confidence") > 0.85, "High").when(F.col("confidence") >= 0.7, "Medium").otherwise("Low")
    issue = F.when(F.col("grounding_score") < GROUNDED, F.concat(F.lit("Low context grounding score: "), F.format_string("%.2f", "grounding_score"), F.lit(f" (threshold: {GROUNDED:.2f})")))
    review = F.lit(False) if review_below is None else F.col("confidence") < review_below
    return rows.select(key, "grounding_score", "confidence", level.alias("level"), review.alias("needs_review"), issue.alias("issue"), F.coalesce("n_claims", F.lit(0)).cast("long").alias("n_claims"), F.coalesce("n_grounded", F.lit(0)).cast("long").alias("n_grounded"))


# Prompts


def render(template: Column, values: dict[str, Column]) -> Column:
    """Replace {{key}} in any case; null values become empty. Values are inserted as they are."""
    for key, value in values.items():
        safe = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1")
        template = F.regexp_replace(template, F.lit(r"(?i)\{\{" + key + r"\}\}"), safe)
    return template


def render_values(template: Column, values: Column) -> Column:
    """:func:`render` with a map column of keys and values, whatever keys each row has, in the map's order."""

    def put(text: Column, entry: Column) -> Column:
        safe = F.regexp_replace(F.coalesce(entry["value"], F.lit("")), r"([\\$])", r"\\$1")
        return F.regexp_replace(text, F.concat(F.lit(r"(?i)\{\{\Q"), entry["key"], F.lit(r"\E\}\}")), safe)

    return F.aggregate(F.map_entries(values), template, put)


def render_prompts(requests: DataFrame, templates: DataFrame, default: str | None = None, ab_test: bool = False) -> DataFrame:
    """``requests`` (query_id, name, version, values: map of texts) with picked_version and the system_prompt and user_prompt of the picked template, rendered;
    both null where there is no such template. ``templates``: name, version, loaded_at, system_prompt, user_prompt."""
    picked = pick_versions(requests, templates, default, ab_test)
    own = templates.select("name", F.col("version").alias("picked_version"), "system_prompt", "user_prompt")
    rows = picked.join(sized(own), ["name", "picked_version"], "left")
    return rows.select(*requests.columns, "picked_version", *[render_values(F.col(c), F.col("values")).alias(c) for c in ("system_prompt", "user_prompt")])


def leftovers(rendered: Column) -> Column:
    return F.regexp_extract_all(rendered, F.lit(r"\{\{(\w+)\}\}"), F.lit(1))


def pick_versions(requests: DataFrame, templates: DataFrame, default: str | None = None, ab_test: bool = False) -> DataFrame:
    """``requests`` (query_id, name, version) with picked_version: the asked one (null if missing), else the default, else for A/B tests a
    stable hash of the query, else the one loaded last."""
    versions = templates.groupBy("name").agg(F.array_sort(F.collect_list("version")).alias("vs"), F.max_by("version", F.struct("loaded_at", "version")).alias("newest"))
    rows = requests.join(sized(versions), "name", "left")  # requests carry whole texts and have few names: a shuffle would deal them by these
    asked = F.get(F.filter("vs", lambda v: F.lower(v) == F.lower(F.col("version"))), F.lit(0))
    standard = F.get(F.filter("vs", lambda v: F.lower(v) == F.lower(F.lit(default))), F.lit(0)) if default else F.lit(None).cast("string")
    hashed = F.get(F.col("vs"), F.pmod(F.conv(F.substring(F.md5(F.col("query_id").cast("string")), 1, 8), 16, 10).cast("long"), F.size("vs")).cast("int")) if ab_test else F.lit(None).cast("string")
    out = F.when(~is_blank(F.col("version")), asked).otherwise(F.coalesce(standard, hashed, F.col("newest")))
    return rows.withColumn("picked_version", out).drop("vs", "newest")


def template_errors(templates: DataFrame) -> DataFrame:
    """Templates (name, version, system_prompt, user_prompt, temperature, max_tokens) with their errors."""
    found = errors(
        (is_blank(F.col("name")), "missing 'name' field"), (is_blank(F.col("system_prompt")), "missing 'system_prompt' field"), (is_blank(F.col("user_prompt")), "missing 'user_prompt_template' field"),
        (~F.col("temperature").between(0, 1), "temperature must be between 0 and 1"), (F.col("max_tokens") <= 0, "max_tokens must be > 0"),
    )
    return templates.withColumn("errors", found)


def degraded(answers: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """Answers that were not generated show their context; model and tokens say so."""
    shown = F.when(is_blank(F.col(context)), "No relevant information found").otherwise(F.concat(F.lit("Generation failed, showing retrieved context:\n\n"), F.col(context)))
    none = F.col(answer).isNull()
    return answers.withColumn("model", F.when(none, "context-only").otherwise(F.col("model"))).withColumn("tokens_used", F.when(none, 0).otherwise(F.col("tokens_used"))).withColumn(answer, F.coalesce(answer, shown))
