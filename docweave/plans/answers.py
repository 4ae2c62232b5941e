"""Queries of context assembly, citations, answer checks and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import excerpt
from ..operators import answers as A
from .fixtures import ANSWERS, QUERIES as QS, RESULTS, answers, queries, results_with_text, table

#: A template with the fixed marks of prompt templates, one of which stays open.
TEMPLATE = "Context:\n{{context}}\n\nQuestion: {{QUERY}}\n\nSources: {{sources}}"


def x1(spark, sf_dir):
    """BM25 scores over 20, so that some queries keep their best row only."""
    r = results_with_text(spark, sf_dir).withColumn("score", F.round(F.col("score") / 20, 8)).drop("rank")
    return A.relevant(r).select("query_id", "rank", "item_id", "score")


_X1 = f"""{RESULTS}, sc AS (SELECT query_id, item_id, round(score / 20, 8) AS score, text, source FROM results),
rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc) WHERE score >= 0.3 OR rank = 1)"""
X1 = f"WITH {_X1} SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM rel"


def x2(spark, sf_dir):
    return A.distinct_texts(A.relevant(results_with_text(spark, sf_dir, 20).drop("rank"))).select("query_id", "rank", "item_id")


_X2 = f"""{RESULTS.replace('<= 10', '<= 20')}, rel AS (SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM results) WHERE score >= 0.3 OR rank = 1),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS rn FROM rel) WHERE rn = 1)"""
X2 = f"WITH {_X2} SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id FROM dd"


def _packed(r: DataFrame, tokens: int) -> DataFrame:
    return A.assemble(r.drop("rank"), tokens).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"), "n_sources")


def x3(spark, sf_dir):
    return _packed(results_with_text(spark, sf_dir, 20), 1000)


def _pack_sql(source: str, limit: int) -> str:
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM {source}),
hd AS (SELECT *, '[Source ' || n || ': ' || coalesce(source, '') || ']' || chr(10) AS head FROM o), tk AS (SELECT *, CAST(ceil(length(head || text || chr(10) || chr(10)) / 4) AS BIGINT) AS tokens FROM hd),
cu AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY n) AS s FROM tk), ov AS (SELECT *, {limit} - (s - tokens) AS room, min(n) FILTER (s > {limit}) OVER (PARTITION BY query_id) AS over_n FROM cu),
pt AS (SELECT query_id, n, CASE WHEN s <= {limit} THEN head || text || chr(10) || chr(10) WHEN room > 20 THEN head || substr(text, 1, CAST((room - least(room // 4, 15)) * 4 AS BIGINT)) || '...' || chr(10) || chr(10) END AS part FROM ov WHERE over_n IS NULL OR n <= over_n),
pk AS (SELECT query_id, coalesce(string_agg(part, '' ORDER BY n), '') AS context, CAST(count(part) AS INTEGER) AS n_sources FROM pt GROUP BY query_id)"""


X3 = f"WITH {_X2}, {_pack_sql('dd', 900)} SELECT query_id, md5(context) AS context_md5, CAST(length(context) AS INTEGER) AS n_chars, n_sources FROM pk"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite one, the third, a missing and no source, some twice."""
    text = F.concat(F.lit("See [Source 1], [source  3] and [SOURCE 99]; [Source 0], [Source 1], [Source "), (F.col("query_id") % 12).cast("string"), F.lit("]. "), "text")
    return queries(spark, sf_dir).select("query_id", text.alias("answer"))


_C = f"{QS}, cited AS (SELECT query_id, 'See [Source 1], [source  3] and [SOURCE 99]; [Source 0], [Source 1], [Source ' || query_id % 12 || ']. ' || text AS answer FROM queries)"
_NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[[Ss][Oo][Uu][Rr][Cc][Ee]\s+(\d+)\]', 1), lambda x: x::INTEGER)))"


def x4(spark, sf_dir):
    return _cited(spark, sf_dir).select("query_id", F.array_join(A.cited(F.col("answer")).cast("array<string>"), ",").alias("cited"))


X4 = f"WITH {_C} SELECT query_id, array_to_string({_NUMBERS}, ',') AS cited FROM cited"


def x5(spark, sf_dir):
    return A.link_sources(_cited(spark, sf_dir), results_with_text(spark, sf_dir)).withColumn("excerpt", F.md5("excerpt"))


X5 = f"""WITH {_C}, {RESULTS[len(QS) + 2:]}, n AS (SELECT query_id, unnest({_NUMBERS}) AS number FROM cited)
SELECT n.query_id, number, item_id AS source_id, source AS title, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS excerpt, score FROM n JOIN results r ON r.query_id = n.query_id AND r.rank = number"""


def x6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


X6 = "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents"


def x7(spark, sf_dir):
    return _cited(spark, sf_dir).select("query_id", A.citation_count(F.col("answer")).alias("n"))


X7 = rf"WITH {_C} SELECT query_id, CAST(len(regexp_extract_all(answer, '(?i)\[Source\s+(\d+)\]')) AS INTEGER) AS n FROM cited"

_STOP = "[" + ", ".join(f"'{w}'" for w in A.STOP_WORDS) + "]"
_REL = rf"""kw AS (SELECT *, list_distinct(list_filter(list_transform(regexp_split_to_array(query, '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))) AS ks FROM answers),
rv AS (SELECT *, CASE WHEN len(ks) = 0 OR NOT regexp_matches(answer, '\S') THEN 0::DOUBLE ELSE round(len(list_filter(ks, lambda k: contains(lower(answer), k))) / len(ks), 6) END AS relevance_score FROM kw)"""


def x8(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("answer_id", A.relevance(F.col("answer"), F.col("query")).alias("relevance_score"))


X8 = f"WITH {ANSWERS}, {_REL} SELECT answer_id, relevance_score FROM rv"


def x9(spark, sf_dir):
    """Some answers lose their citation or their text."""
    a = answers(spark, sf_dir).withColumn("answer", F.when(F.col("answer_id") % 5 == 0, F.lit(" ")).when(F.col("answer_id") % 3 == 0, F.replace("answer", F.lit("[Source"), F.lit("[S"))).otherwise(F.col("answer")))
    return A.validate(a).select("answer_id", "relevance_score", "citation_count", F.array_join("issues", "; ").alias("issues"), "is_valid")


X9 = rf"""WITH {ANSWERS.replace('answers AS', 'answers0 AS')}, answers AS (SELECT * REPLACE (CASE WHEN answer_id % 5 = 0 THEN ' ' WHEN answer_id % 3 = 0 THEN replace(answer, '[Source', '[S') ELSE answer END AS answer) FROM answers0), {_REL},
c AS (SELECT *, CAST(CASE WHEN answer = ' ' THEN 0 ELSE len(regexp_extract_all(answer, '(?i)\[Source\s+(\d+)\]')) END AS INTEGER) AS citation_count FROM rv),
i AS (SELECT *, CASE WHEN answer = ' ' THEN 'Response is empty or whitespace' ELSE array_to_string(list_filter([CASE WHEN citation_count = 0 THEN 'Response missing source citations in format [Source N]' END,
  CASE WHEN relevance_score < 0.3 THEN 'Response may not be relevant to query (relevance score: ' || printf('%.2f', round(relevance_score, 2)) || ')' END], lambda x: x IS NOT NULL), '; ') END AS issues FROM c)
SELECT answer_id, relevance_score, citation_count, issues, issues = '' AS is_valid FROM i"""

_CLAIMS = r"""cl AS (SELECT answer_id, context, unnest(s) AS claim, unnest(range(0, len(s))) AS position FROM (SELECT answer_id, context, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM answers WHERE regexp_matches(answer, '\S')))"""
_GROUND = r"""ng AS (SELECT *, lower(context) AS ctx, list_filter(regexp_split_to_array(lower(claim), '[ \t\n\r.,!?]'), lambda w: w <> '') AS ws FROM cl WHERE regexp_matches(context, '\S')),
gr AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) AS g3, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')) AS g2, list_distinct(list_filter(ws, lambda w: length(w) > 2)) AS g1 FROM ng),
sh AS (SELECT *, [coalesce(len(list_filter(g1, lambda x: contains(ctx, x))) / nullif(len(g1), 0), 0), coalesce(len(list_filter(g2, lambda x: contains(ctx, x))) / nullif(len(g2), 0), 0), coalesce(len(list_filter(g3, lambda x: contains(ctx, x))) / nullif(len(g3), 0), 0)] AS r FROM gr),
gc AS (SELECT answer_id, CAST(position AS INTEGER) AS position, claim, round(CASE WHEN len(ws) < 2 THEN r[1] ELSE r[3] * 0.6::DOUBLE + r[2] * 0.4::DOUBLE END, 6) AS score FROM sh)"""


def x10(spark, sf_dir):
    return answers(spark, sf_dir).select("answer_id", F.posexplode(A.claims(F.col("answer"))).alias("position", "claim"))


X10 = f"WITH {ANSWERS}, {_CLAIMS} SELECT answer_id, CAST(position AS INTEGER) AS position, claim FROM cl"


def x11(spark, sf_dir):
    """Claims against their context; half of the contexts hold the answer's own words."""
    a = answers(spark, sf_dir).withColumn("context", F.when(F.col("answer_id") % 2 == 0, F.concat_ws(" ", "context", "answer")).otherwise(F.col("context")))
    return A.ground_claims(a)


_MIXED = f"{ANSWERS.replace('answers AS', 'answers0 AS')}, answers AS (SELECT * REPLACE (CASE WHEN answer_id % 2 = 0 THEN concat_ws(' ', context, answer) ELSE context END AS context) FROM answers0)"
X11 = f"WITH {_MIXED}, {_CLAIMS}, {_GROUND} SELECT *, score >= 0.7 AS is_grounded FROM gc"


def x12(spark, sf_dir):
    """Single words of queries as claims against the answers."""
    a = answers(spark, sf_dir).select("answer_id", F.explode(F.split("query", " ")).alias("claim"), "answer").where("claim <> ''")
    return a.select("answer_id", "claim", A.grounding(F.col("claim"), F.col("answer")).alias("score")).distinct()


X12 = rf"""WITH {ANSWERS}, cl AS (SELECT DISTINCT answer_id, claim, answer AS context FROM (SELECT answer_id, answer, unnest(string_split(query, ' ')) AS claim FROM answers) WHERE claim <> ''), c0 AS (SELECT *, 0 AS position FROM cl),
{_GROUND.replace('FROM cl WHERE', 'FROM c0 WHERE')} SELECT answer_id, claim, score FROM gc"""


def x13(spark, sf_dir):
    a = answers(spark, sf_dir).withColumn("context", F.when(F.col("answer_id") % 7 == 0, " ").when(F.col("answer_id") % 2 == 0, F.concat_ws(" ", "context", "answer")).otherwise(F.col("context")))
    return A.ground(a, review_below=0.7)


X13 = rf"""WITH {ANSWERS.replace('answers AS', 'answers0 AS')}, answers AS (SELECT * REPLACE (CASE WHEN answer_id % 7 = 0 THEN ' ' WHEN answer_id % 2 = 0 THEN concat_ws(' ', context, answer) ELSE context END AS context) FROM answers0), {_CLAIMS}, {_GROUND},
s AS (SELECT answer_id, avg(score) AS s, count(*) AS n_claims, count(*) FILTER (score >= 0.7) AS n_grounded FROM gc GROUP BY answer_id),
r AS (SELECT answer_id, round(CASE WHEN NOT regexp_matches(context, '\S') THEN 0 ELSE coalesce(s, 1) END, 6)::DOUBLE AS grounding_score, coalesce(n_claims, 0) AS n_claims, coalesce(n_grounded, 0) AS n_grounded FROM answers LEFT JOIN s USING (answer_id))
SELECT answer_id, grounding_score, grounding_score AS confidence, CASE WHEN grounding_score > 0.85 THEN 'High' WHEN grounding_score >= 0.7 THEN 'Medium' ELSE 'Low' END AS level, grounding_score < 0.7 AS needs_review,
  CASE WHEN grounding_score < 0.7 THEN 'Low context grounding score: ' || printf('%.2f', round(grounding_score, 2)) || ' (threshold: 0.70)' END AS issue, n_claims, n_grounded FROM r"""


def x14(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("answer_id", A.render(F.lit(TEMPLATE), {"context": F.col("context"), "query": F.concat(F.lit("$1 \\ "), "query")}).alias("prompt"))


X14 = f"WITH {ANSWERS} SELECT answer_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: $1 \\ ' || query || chr(10) || chr(10) || 'Sources: {{{{sources}}}}' AS prompt FROM answers"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates made of documents: named by language, versions by source."""
    d = table(spark, sf_dir, "documents")
    t = d.groupBy(F.col("lang").alias("name"), F.col("source").alias("version")).agg(F.min("doc_id").alias("loaded_at"), F.max("n_chars").alias("most"))
    return t.select("name", "version", "loaded_at", F.when(F.col("loaded_at") % 3 == 0, "").otherwise("s").alias("system_prompt"), F.lit("{{query}}").alias("user_prompt"), (F.col("loaded_at") % 12 / 10.0).alias("temperature"), (F.col("most") - 9000).alias("max_tokens"))


_TP = "tp AS (SELECT lang AS name, source AS version, min(doc_id) AS loaded_at, max(n_chars) - 9000 AS max_tokens FROM documents GROUP BY ALL)"


def x15(spark, sf_dir):
    """One document in three asks for a version (one in nine for a missing one), the others get the default if their language has it."""
    d = table(spark, sf_dir, "documents")
    ask = F.when(F.col("doc_id") % 9 == 0, "none").when(F.col("doc_id") % 3 == 0, F.upper("source"))
    r = d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("name"), ask.alias("version"))
    return A.pick_versions(r, templates(spark, sf_dir), default="SRC3").select("query_id", "picked_version")


X15 = f"""WITH {_TP}, nw AS (SELECT name, max_by(version, loaded_at) AS newest, max(CASE WHEN version = 'src3' THEN version END) AS std FROM tp GROUP BY name)
SELECT doc_id AS query_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN source ELSE coalesce(std, newest) END AS picked_version FROM documents JOIN nw ON name = lang"""


def x15_ab(spark, sf_dir):
    """The same without versions asked for: every document's language has its versions tested against each other."""
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("name"), F.lit(None).cast("string").alias("version"))
    return A.pick_versions(r, templates(spark, sf_dir), ab_test=True).select("query_id", "picked_version")


X15_AB = f"""WITH {_TP}, vs AS (SELECT name, list_sort(list(version)) AS vs FROM tp GROUP BY name)
SELECT doc_id AS query_id, vs[CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % len(vs) AS INTEGER) + 1] AS picked_version FROM documents JOIN vs ON name = lang"""


def x14_templates(spark, sf_dir):
    """Every document's text rendered by the picked template of its language; keys in any case, one without a value, one that no template has."""
    d = table(spark, sf_dir, "documents")
    t = templates(spark, sf_dir).withColumn("system_prompt", F.concat(F.lit("{{ROLE}} of "), "version")).withColumn("user_prompt", F.concat(F.lit("From {{Context}}: {{query}}{{none}} {{missing}} #"), F.col("loaded_at").cast("string")))
    values = F.create_map(F.lit("role"), F.concat(F.lit("$1 \\ "), "lang"), F.lit("context"), F.col("source"), F.lit("query"), F.col("text"), F.lit("none"), F.lit(None).cast("string"), F.lit("other"), F.lit("x"))
    ask = F.when(F.col("doc_id") % 9 == 0, "none").when(F.col("doc_id") % 3 == 0, F.upper("source"))
    r = d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("name"), ask.alias("version"), values.alias("values"))
    return A.render_prompts(r, t, ab_test=True).select("query_id", "picked_version", F.md5("system_prompt").alias("system_md5"), F.md5("user_prompt").alias("user_md5"))


X14_TEMPLATES = f"""WITH {_TP}, vs AS (SELECT name, list_sort(list(version)) AS vs FROM tp GROUP BY name),
r AS (SELECT doc_id AS query_id, lang AS name, source, text, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN source ELSE vs[CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % len(vs) AS INTEGER) + 1] END AS picked_version FROM documents JOIN vs ON name = lang)
SELECT query_id, picked_version, CASE WHEN loaded_at IS NOT NULL THEN md5('$1 \\ ' || r.name || ' of ' || picked_version) END AS system_md5, CASE WHEN loaded_at IS NOT NULL THEN md5('From ' || source || ': ' || coalesce(text, '') || ' {{{{missing}}}} #' || loaded_at) END AS user_md5
FROM r LEFT JOIN tp ON tp.name = r.name AND tp.version = r.picked_version"""


def x16(spark, sf_dir):
    t = A.template_errors(templates(spark, sf_dir))
    return t.select("name", "version", F.array_join("errors", "; ").alias("errors"), F.array_join(A.leftovers(F.col("user_prompt")), ",").alias("leftovers"))


X16 = f"""WITH {_TP} SELECT name, version, array_to_string(list_filter([CASE WHEN loaded_at % 3 = 0 THEN 'missing ''system_prompt'' field' END, CASE WHEN loaded_at % 12 > 10 THEN 'temperature must be between 0 and 1' END,
  CASE WHEN max_tokens <= 0 THEN 'max_tokens must be > 0' END], lambda x: x IS NOT NULL), '; ') AS errors, 'query' AS leftovers FROM tp"""


def x17(spark, sf_dir):
    a = answers(spark, sf_dir).withColumn("context", F.when(F.col("answer_id") % 4 == 0, "").otherwise(F.col("context")))
    a = a.select("answer_id", F.when(F.col("answer_id") % 2 == 1, F.col("answer")).alias("answer"), "context", F.lit("m").alias("model"), F.lit(7).alias("tokens_used"))
    return A.degraded(a).select("answer_id", "answer", "model", "tokens_used")


X17 = f"""WITH {ANSWERS} SELECT answer_id, CASE WHEN answer_id % 2 = 1 THEN answer WHEN answer_id % 4 = 0 OR NOT regexp_matches(context, '\\S') THEN 'No relevant information found' ELSE 'Generation failed, showing retrieved context:' || chr(10) || chr(10) || context END AS answer,
  CASE WHEN answer_id % 2 = 1 THEN 'm' ELSE 'context-only' END AS model, CAST(CASE WHEN answer_id % 2 = 1 THEN 7 ELSE 0 END AS INTEGER) AS tokens_used FROM answers"""

QUERIES = {
    "x1_relevant": x1, "x2_distinct_texts": x2, "x3_context": x3, "x4_citations": x4, "x5_sources": x5, "x6_excerpt": x6, "x7_citation_count": x7, "x8_relevance": x8, "x9_validation": x9, "x10_claims": x10,
    "x11_grounding": x11, "x12_word_overlap": x12, "x13_grounding_summary": x13, "x14_prompts": x14, "x14_prompts_by_template": x14_templates, "x15_template_versions": x15, "x15_ab_versions": x15_ab, "x16_template_check": x16, "x17_degraded": x17,
}
ORACLE_SQL = {
    "x1_relevant": X1, "x2_distinct_texts": X2, "x3_context": X3, "x4_citations": X4, "x5_sources": X5, "x6_excerpt": X6, "x7_citation_count": X7, "x8_relevance": X8, "x9_validation": X9, "x10_claims": X10,
    "x11_grounding": X11, "x12_word_overlap": X12, "x13_grounding_summary": X13, "x14_prompts": X14, "x14_prompts_by_template": X14_TEMPLATES, "x15_template_versions": X15, "x15_ab_versions": X15_AB, "x16_template_check": X16, "x17_degraded": X17,
}
