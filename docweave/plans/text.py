"""Queries of intake, cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.common import is_blank, spread
from ..operators import chunking, cleaning, intake
from .fixtures import CHUNKS, chunks, documents, table

#: The English and Ukrainian rule sets, and what the academic one adds.
ENGLISH = cleaning.Rules(
    artifacts=["Signature", "signature", "(signature)", "Date", "date", "(date)", "Approved", "APPROVED"],
    fields=[r"^[\s_]{10,}$"],
    signatures=[r"(?:Name|Position|Title|Department)[_\s,:]{5,}"],
    dates=["__/__/____", r"\d{0,2}/\d{0,2}/\d{0,4}"],
    spacing="([a-z])([A-Z][a-z])",
    spacing_on=True,
    table=", ",
    repeated=(2, 30),
)
#: What queries put before a document's text, as the given texts hold no such characters.
FANCY = "\u201cQuote\u201d \u2018q\u2019 \u2013 a\u2014b\u00a0c\u2003d\u2002e\u2009f\u200bg e\u0301 "
FORM = "Name: _____ \n__________\n12/03/2024 Signature ____ Approved:yes ,then .And\tTab  x   \n\n\n\nEnd"


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the last part of the url with an extension, and the html's bytes."""
    p = table(spark, sf_dir, "pages")
    ext = F.element_at(F.array(*map(F.lit, [".txt", ".PDF", ".docx", ".exe", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("page_id") % 7 == 0, "../").otherwise(""), F.lit("page"), F.col("page_id").cast("string"), ext)
    files = p.select("page_id", name.alias("file_name"), F.when(F.col("page_id") % 11 == 0, 0).otherwise(F.octet_length("html")).cast("long").alias("length"))
    return intake.check_files(files, most=5000 * 1).select("page_id", F.array_join("errors", "; ").alias("errors"), "route")


S2 = r"""WITH f AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '../' ELSE '' END || 'page' || page_id || ['.txt', '.PDF', '.docx', '.exe', ''][page_id % 5 + 1] AS file_name,
  CASE WHEN page_id % 11 = 0 THEN 0 ELSE strlen(html) END AS length FROM pages),
e AS (SELECT *, lower(regexp_extract(file_name, '(\.[^./\\]+)$', 1)) AS ext FROM f),
r AS (SELECT page_id, ext, CASE WHEN length = 0 THEN 'File cannot be empty' ELSE array_to_string(list_filter([
  CASE WHEN length > 5000 THEN 'File size exceeds maximum allowed size of 0 MB' END,
  CASE WHEN ext NOT IN ('.pdf', '.docx', '.txt') THEN 'File type ''' || ext || ''' is not allowed. Allowed types: .pdf, .docx, .txt' END,
  CASE WHEN contains(file_name, '..') OR contains(file_name, '/') THEN 'Invalid file name' END], lambda x: x IS NOT NULL), '; ') END AS errors FROM e)
SELECT page_id, errors, CASE WHEN errors <> '' THEN 'rejected' WHEN ext = '.txt' THEN 'accepted' ELSE 'unsupported' END AS route FROM r"""


def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets made of the sources: enabled ones united in order, last thresholds win."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("position"), F.array_sort(F.collect_set("lang")).alias("artifacts"), F.count(F.lit(1)).alias("n"))
    sets = d.select("position", (F.col("position") % 3 != 0).alias("enabled"), "artifacts", F.when(F.col("position") % 2 == 0, F.col("n")).alias("threshold"))
    return cleaning.merge_rules(sets).select("n_sets", F.array_join(F.array_sort("artifacts"), ",").alias("artifacts"), "threshold")


S4 = """WITH d AS (SELECT source, min(doc_id) AS position, count(*) AS n FROM documents GROUP BY source), e AS (SELECT * FROM d WHERE position % 3 <> 0)
SELECT (SELECT count(*) FROM e) AS n_sets, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents JOIN e USING (source))) AS artifacts,
(SELECT max_by(n, position) FROM e WHERE position % 2 = 0) AS threshold"""


def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", intake.fingerprint(F.col("text")).alias("hash"))


D1 = "SELECT doc_id, sha256(text) AS hash FROM documents"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select((F.col("doc_id") % 4).cast("string").alias("tenant_id"), "doc_id", intake.fingerprint(F.col("text")).alias("hash"))


_UP = "u AS (SELECT CAST(doc_id % 4 AS VARCHAR) AS tenant_id, doc_id, sha256(text) AS hash FROM documents)"


def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the documents against hashes of the first."""
    u = uploads(spark, sf_dir)
    known = intake.new_hashes(u.where("doc_id % 2 = 0"))
    return intake.duplicates(u.where("doc_id % 2 = 1"), known).select("tenant_id", "doc_id", "status", "existing_id")


D2 = f"""WITH {_UP}, h AS (SELECT tenant_id, hash, min(doc_id) AS known FROM u WHERE doc_id % 2 = 0 GROUP BY ALL),
f AS (SELECT tenant_id, hash, min(doc_id) AS first FROM u WHERE doc_id % 2 = 1 GROUP BY ALL),
x AS (SELECT u.tenant_id, u.doc_id, coalesce(known, first) AS existing_id FROM u JOIN f USING (tenant_id, hash) LEFT JOIN h USING (tenant_id, hash) WHERE doc_id % 2 = 1)
SELECT tenant_id, doc_id, CASE WHEN existing_id = doc_id THEN 'Uploaded' ELSE 'AlreadyExists' END AS status, existing_id FROM x"""


def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.new_hashes(uploads(spark, sf_dir))


D3 = f"WITH {_UP} SELECT tenant_id, hash, min(doc_id) AS document_id FROM u GROUP BY tenant_id, hash"


def _docs(spark: SparkSession, sf_dir: str, before: str = "", after: str = "") -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.concat(F.lit(before), F.col("text"), F.lit(after)).alias("text"))


def _step(step, before: str = "", after: str = ""):
    return lambda spark, sf_dir: _docs(spark, sf_dir, before, after).select("doc_id", F.md5(step(F.col("text"))).alias("text_md5"), F.length(step(F.col("text"))).alias("n_chars"))


def _sql(expression: str, before: str = "", after: str = "") -> str:
    b, a = (x.replace("'", "''") for x in (before, after))
    return f"WITH d AS (SELECT doc_id, '{b}' || text || '{a}' AS t FROM documents), r AS (SELECT doc_id, {expression} AS x FROM d) SELECT doc_id, md5(x) AS text_md5, CAST(length(x) AS INTEGER) AS n_chars FROM r"


_T1 = "translate(nfc_normalize(t), '" + "".join(T.CHARACTERS).replace("'", "''") + "', '" + "".join(T.CHARACTERS.values()).replace("'", "''") + "')"


def _chain(expression: str, *steps: tuple[str, str, str]) -> str:
    for pattern, new, flags in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{new}', '{flags}')"
    return expression


def _artifacts(expression: str) -> str:
    for a in ENGLISH.artifacts:
        expression = f"replace({expression}, '{a}', '')"
    return expression


def _t2(t: str) -> str:
    return _artifacts(_chain(t, ("__/__/____", "", "g"), (r"\d{0,2}/\d{0,2}/\d{0,4}", "", "g"), (ENGLISH.signatures[0], "", "gi"), ("(?m)" + ENGLISH.fields[0], "\n", "g"), ("_{3,}", "", "g")))


def _t3(t: str) -> str:
    return _chain(t, (ENGLISH.spacing, r"\1 \2", "g"), (r"\s+([,;:.!?])", r"\1", "g"), (r"([,;:.!?])([A-Za-z0-9\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}])", r"\1 \2", "g"))


def _t4(t: str) -> str:
    return _chain(f"replace({t}, chr(9), ' ')", (" {2,}", " ", "g"), (r"(?m)[^\S\n]+$", "", "g"), (r"\n{3,}", "\n\n", "g"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _t5(name: str, source: str, threshold: int, least: int) -> str:
    """Common table expressions: ``name`` (doc_id, t) from ``source`` (doc_id, t)."""
    n = name
    return rf"""{n}_l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS p FROM {source}),
{n}_k AS (SELECT *, {_TRIM.format('line')} AS k FROM {n}_l),
{n}_m AS (SELECT *, length(k) >= {least} AND count(*) OVER (PARTITION BY doc_id, k) >= {threshold} AS many, row_number() OVER (PARTITION BY doc_id, k ORDER BY p) AS rn FROM {n}_k),
{n} AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) FILTER (NOT many OR rn = 1) || CASE WHEN bool_or(many) THEN chr(10) ELSE '' END AS t FROM {n}_m GROUP BY doc_id)"""


def _t6(t: str) -> str:
    return _chain(t, (r"\s*\|\s*", ", ", "g"))


def _t7(t: str) -> str:
    inner = _chain(_TRIM.format(t), (r"\n\s*\n", "\n\n", "g"))
    lines = rf"list_transform(string_split({inner}, chr(10)), lambda x: {_TRIM.format('x')})"
    return f"array_to_string((SELECT list_filter(ls, lambda x, j: x <> '' OR j = 1 OR ls[j - 1] <> '') FROM (SELECT {lines} AS ls)), chr(10))"


def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cleaning.remove_repeated_lines(_docs(spark, sf_dir), threshold=2, least=10)
    return d.select("doc_id", F.md5("cleaned").alias("text_md5"), F.length("cleaned").alias("n_chars"))


T5 = "WITH d AS (SELECT doc_id, text AS t FROM documents), " + _t5("r", "d", 2, 10) + " SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM r"


def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cleaning.clean(_docs(spark, sf_dir, FANCY + FORM), ENGLISH)
    return d.select("doc_id", F.md5("cleaned").alias("text_md5"), F.array_join("applied", ",").alias("applied"), "chars_before", "chars_after", "reduction")


def _clean_ctes(source: str) -> str:
    """d0 .. cleaned: the composite cleaner over ``source`` (doc_id, t)."""
    return (
        f"c1 AS (SELECT doc_id, t AS raw, {_t4(_t3(_t2(_T1)))} AS t FROM {source}), " + _t5("c2", "c1", 2, 30)
        + f", c3 AS (SELECT doc_id, CASE WHEN contains(t, '|') THEN {_t6('t')} ELSE t END AS t, contains(t, '|') AS tables FROM c2), c4 AS (SELECT doc_id, tables, {_t7('t')} AS cleaned FROM c3)"
    )


T8 = (
    f"WITH d AS (SELECT doc_id, '{(FANCY + FORM)}' || text AS t FROM documents), " + _clean_ctes("d")
    + """ SELECT doc_id, md5(cleaned) AS text_md5, 'UnicodeNormalization,FormArtifactRemoval,WordSpacingFix,WhitespaceNormalization,RepetitiveContentRemoval,' || CASE WHEN tables THEN 'TableFormattingCleanup,' ELSE '' END || 'FinalCleanup' AS applied,
CAST(length(raw) AS INTEGER) AS chars_before, CAST(length(cleaned) AS INTEGER) AS chars_after, round((length(raw) - length(cleaned)) * 100.0 / length(raw), 6)::DOUBLE AS reduction FROM c4 JOIN c1 USING (doc_id)"""
)


def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without letters are blanked, to have rejects."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "  \n").when(F.col("doc_id") % 9 == 1, "Signature").otherwise(F.col("text")).alias("text"))
    return cleaning.tag_rejects(cleaning.clean(d, ENGLISH)).select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("status"))


T9 = (
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) WHEN doc_id % 9 = 1 THEN 'Signature' ELSE text END AS t FROM documents), " + _clean_ctes("d")
    + f" SELECT doc_id, CASE WHEN {_TRIM.format('raw')} = '' THEN 'no text extracted' WHEN cleaned = '' THEN 'no text after cleaning' ELSE 'accepted' END AS status FROM c4 JOIN c1 USING (doc_id)"
)


def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("tenant_id", "doc_id", "chunk_index", "chunk_id", F.md5("text").alias("text_md5"), "start_index", "end_index", "word_count")


K1 = f"WITH {CHUNKS} SELECT tenant_id, doc_id, chunk_index, chunk_id, md5(text) AS text_md5, start_index, CAST(start_index + length(text) AS INTEGER) AS end_index, word_count FROM chunks"


def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "word_count", "token_count", "strategy")


K2 = f"WITH {CHUNKS} SELECT chunk_id, word_count, CAST(floor(word_count * 1.3::DOUBLE) AS INTEGER) AS token_count, 'SlidingWindow' AS strategy FROM chunks"


def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n_tokens"))


K3 = "SELECT doc_id, CAST(coalesce(ceil(length(text) / 4), 0) AS INTEGER) AS n_tokens FROM documents"


def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("file_name", F.concat("title", F.lit(".v1.TXT")))
    m = chunking.document_metadata(d, chunks(spark, sf_dir))
    return m.select("doc_id", "extension", "chars", "n_chunks", F.md5(F.array_join("chunk_ids", ",")).alias("ids_md5"))


K4 = f"""WITH {CHUNKS}, g AS (SELECT doc_id, count(*) AS n, string_agg(chunk_id, ',' ORDER BY chunk_index) AS ids FROM chunks GROUP BY doc_id)
SELECT doc_id, '.txt' AS extension, CAST(length(text) AS INTEGER) AS chars, coalesce(n, 0) AS n_chunks, md5(coalesce(ids, '')) AS ids_md5 FROM documents LEFT JOIN g USING (doc_id)"""


def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which some are spoilt on purpose."""
    c = chunks(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.col("text"))).withColumn("start_index", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("start_index")))
    c = c.withColumn("end_index", F.when(F.col("doc_id") % 11 == 0, -5).otherwise(F.col("end_index")))
    return chunking.chunk_errors(c).select("chunk_id", F.array_join("errors", "; ").alias("errors"))


K5 = f"""WITH {CHUNKS}, e AS (SELECT chunk_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 OR trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'text is empty' END,
  CASE WHEN doc_id % 7 = 0 THEN 'start is negative' END,
  CASE WHEN CASE WHEN doc_id % 11 = 0 THEN -5 ELSE start_index + length(text) END <= CASE WHEN doc_id % 7 = 0 THEN -1 ELSE start_index END THEN 'end is not after start' END], lambda x: x IS NOT NULL), '; ') AS errors FROM chunks)
SELECT * FROM e WHERE errors <> ''"""


def vectorise(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: lengths and letter counts."""
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    e = chunking.embed(c.where(~is_blank(F.col("text"))), vectorise, 3)
    return e.select("chunk_id", *[F.get("embedding", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("n_chars", "n_e", "n_spaces"))])


K6 = f"WITH {CHUNKS} SELECT chunk_id, length(text) AS n_chars, length(text) - length(replace(text, 'e', '')) AS n_e, length(text) - length(replace(text, ' ', '')) AS n_spaces FROM chunks WHERE regexp_matches(text, '\\S')"

QUERIES = {
    "s2_intake_check": s2, "s4_merge_rules": s4, "d1_fingerprint": d1, "d2_duplicates": d2, "d3_first_writer": d3,
    "t1_unicode": _step(T.normalize_unicode, FANCY), "t2_form_artifacts": _step(lambda c: T.remove_form_artifacts(c, ENGLISH.dates, ENGLISH.signatures, ENGLISH.fields, ENGLISH.artifacts), FORM),
    "t3_word_spacing": _step(lambda c: T.fix_word_spacing(c, ENGLISH.spacing), FORM), "t4_whitespace": _step(T.normalize_whitespace, FORM), "t5_repeated_lines": t5,
    "t5_repeated_lines_in_row": _step(lambda c: T.remove_repeated_lines(c, 2, 10)), "t6_tables": _step(T.clean_tables), "t7_finish": _step(T.finish, " \n ", "\n \n\n x \n\n"), "t8_clean": t8, "t9_rejects": t9,
    "k1_chunks": k1, "k2_chunk_metadata": k2, "k3_token_estimate": k3, "k4_document_metadata": k4, "k5_chunk_errors": k5, "k6_embedding_stage": k6,
}

ORACLE_SQL = {
    "s2_intake_check": S2, "s4_merge_rules": S4, "d1_fingerprint": D1, "d2_duplicates": D2, "d3_first_writer": D3,
    "t1_unicode": _sql(_T1, FANCY), "t2_form_artifacts": _sql(_t2("t"), FORM), "t3_word_spacing": _sql(_t3("t"), FORM), "t4_whitespace": _sql(_t4("t"), FORM), "t5_repeated_lines": T5,
    "t5_repeated_lines_in_row": T5, "t6_tables": _sql(_t6("t")), "t7_finish": _sql(_t7("t"), " \n ", "\n \n\n x \n\n"), "t8_clean": T8, "t9_rejects": T9,
    "k1_chunks": K1, "k2_chunk_metadata": K2, "k3_token_estimate": K3, "k4_document_metadata": K4, "k5_chunk_errors": K5, "k6_embedding_stage": K6,
}

