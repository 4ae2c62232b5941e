"""Registered queries of the training-data operators, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import alignment, exact_dedup, extraction, host_rules, language, mixing, near_dedup, quality, runs, sentencepieces, simhash, substring_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.fold(F.col("doc_id"), 3) == 1
    model = quality.learn(docs, labels.where(~held_out))
    out = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: What the edits of the token-count query replace: addresses of e-mail, and runs of four digits or more.
PERSONAL, PLACEHOLDER = r"[\w.+-]++@[\w-]+(?:\.[\w-]+)+|\d{4,}", "<redacted>"
#: What every match of PERSONAL holds; digits are those of any script in both.
NEEDS = r"[@\d]"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.edits_for(table(spark, sf_dir, "documents").select("doc_id", "text"), PERSONAL, PLACEHOLDER, needs=NEEDS)
    return token_counts.count_edited(docs, token_counts.ranks_of(), keep=["doc_id"])


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold(F.col("doc_id"), 5) == 0
    model = language.learn(docs.where(~held_out), "text", "lang", "doc_id")
    out = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.learn(pages), keep=["page_id", "url"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.selectExpr("row.doc_id", "size", "source_size", "target", "size * copies AS taken", "copies")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), sentencepieces.load(), keep=["doc_id"])


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], spin=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_token_counts, op3_host_rules, op4_language, op5_exact_dedup, op6_extraction, op7_mixing, op8_substring_dedup, op9_near_dedup, op10_sentencepieces,
    op11_simhash, op12_periodic_runs, op13_alignment)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op3_host_rules": rf"""
WITH w AS (SELECT doc_id, source, text, {_WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(f / n) AS mean, var_samp(f / n) AS v, avg(1 / n) AS inv, count(*) AS c FROM h),
t AS (SELECT *, coalesce(v, 0) - mean * (1 - mean) * inv AS between_ FROM p),
s AS (SELECT mean, CASE WHEN c < 3 THEN 100.0::DOUBLE WHEN between_ <= 0 THEN 1e6::DOUBLE ELSE least(1e6, greatest(1.0, mean * (1 - mean) / between_ - 1)) END AS k FROM t),
q AS (SELECT source, n, mean, k, (f + mean * k) / (n + k) AS rate FROM h, s),
r AS (SELECT source, round(rate, 6) AS host_rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + k + 1)) AS low, mean FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
       NOT base_failed AND NOT coalesce(round(low * (1 - mean), 9) > round(2.0::DOUBLE * mean * (1 - low), 9), false) AS kept
FROM b LEFT JOIN r USING (source)""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)""",
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, ('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h,
           CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src FROM documents),
s AS (SELECT src, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
u AS (SELECT *, 2.0::DOUBLE * coalesce(CAST(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
             CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open FROM w),
f AS (SELECT *, (total - before) * weight >= source_size * 2.0::DOUBLE * open AS filled FROM u),
g AS (SELECT src, source_size, CASE WHEN filled THEN source_size * 2.0::DOUBLE ELSE
        weight * (total - 2.0::DOUBLE * coalesce(CAST(sum(source_size) FILTER (filled) OVER () AS BIGINT), 0)) / CAST(sum(weight) FILTER (NOT filled) OVER () AS DOUBLE) END AS target FROM f),
e AS (SELECT *, least(33554432, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target / source_size * 16777216) AS BIGINT) END) AS each_ FROM g),
c AS (SELECT d.*, source_size, target, each_, CAST(sum(each_) OVER (PARTITION BY d.src ORDER BY length(bin(size)) * 8 + ((size * 8) >> length(bin(size))), h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
        + ('0x' || substr(md5('mix' || d.src), 1, 8))::BIGINT % 16777216 AS fin FROM d JOIN e USING (src))
SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken, copies
FROM (SELECT *, (fin // 16777216) - ((fin - each_) // 16777216) AS copies FROM c)""",
    "op8_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS k FROM (FROM pos ANTI JOIN cov USING (doc_id, p)) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.c + ny.c - i)),
both_ AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)""",
    "op12_periodic_runs": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
h AS (SELECT *, len(ws) AS n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h FROM w),
g AS (SELECT *, h // 10 % n AS a, h // 10 AS g FROM h),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE ws END AS ws FROM g),
pos AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM t),
eq AS (SELECT x.doc_id, y.i - x.i AS p, y.i FROM pos x JOIN pos y USING (doc_id, word) WHERE y.i > x.i AND y.i - x.i <= y.n // 4),
cand AS (SELECT doc_id, p, min(i) - p AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM eq) GROUP BY doc_id, p, k HAVING count(*) >= 3 * p AND count(*) + p >= 6),
runs AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand d WHERE d.doc_id = c.doc_id AND d.p < c.p AND d.s <= c.s AND d.s + d.l >= c.s + c.l)),
best AS (SELECT doc_id, s, l, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, p) AS k FROM runs) WHERE k = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS told FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (FROM pos ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, p AS period, 1000 * l // p AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
