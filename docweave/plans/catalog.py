"""Queries of the document catalogue, access lists and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import access, documents as D, usage
from ..session import scratch
from .fixtures import CHUNKS, DOCS, GRANTS, REQUESTS, chunks, documents, grants, requests, table


def m1(spark, sf_dir):
    return D.page(documents(spark, sf_dir), "src1", 2, 5, title="doc-").select("doc_id", "title", "total", "pages", "has_next", "has_previous")


M1 = f"""WITH {DOCS}, r AS (SELECT doc_id, title, count(*) OVER () AS n FROM docs WHERE tenant_id = 'src1' AND contains(title, 'doc-'))
SELECT doc_id, title, CAST(n AS INTEGER) AS total, CAST(ceil(n / 5) AS INTEGER) AS pages, ceil(n / 5) > 2 AS has_next, true AS has_previous FROM r ORDER BY doc_id DESC LIMIT 5 OFFSET 5"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant_id, doc_id) of access requests: most name the wrong tenant."""
    return requests(spark, sf_dir).select("tenant_id", "doc_id")


def m2(spark, sf_dir):
    return D.look_up(documents(spark, sf_dir), wanted(spark, sf_dir)).select("tenant_id", "doc_id", "owner_id")


M2 = f"WITH {DOCS}, {REQUESTS} SELECT tenant_id, doc_id, owner_id FROM docs SEMI JOIN requests USING (tenant_id, doc_id)"


def m3(spark, sf_dir):
    return D.list_chunks(chunks(spark, sf_dir), wanted(spark, sf_dir))


M3 = f"WITH {CHUNKS}, {REQUESTS} SELECT tenant_id, doc_id, chunk_index, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM chunks SEMI JOIN requests USING (tenant_id, doc_id)"


def admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 150).alias("user_id")).where("user_id = 0").distinct()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.decide(requests(spark, sf_dir), documents(spark, sf_dir), grants(spark, sf_dir), admins(spark, sf_dir))


def m5(spark, sf_dir):
    return decisions(spark, sf_dir).select("request_id", "user_id", "doc_id", "needed", "allowed", "reason")


_M5 = f"""{DOCS}, {GRANTS}, {REQUESTS}, dc AS (SELECT r.*, CASE WHEN r.user_id = 0 THEN 'admin' WHEN d.doc_id IS NULL THEN 'not found' WHEN d.tenant_id <> r.tenant_id THEN 'other tenant' WHEN d.owner_id = r.user_id THEN 'owner'
  WHEN g.permission >= r.needed THEN 'granted' WHEN d.is_public AND r.needed = 1 THEN 'public' ELSE 'no permission' END AS reason
  FROM requests r LEFT JOIN docs d USING (doc_id) LEFT JOIN grants g ON g.doc_id = r.doc_id AND g.user_id = r.user_id),
de AS (SELECT *, reason IN ('admin', 'owner', 'granted', 'public') AS allowed FROM dc)"""
M5 = f"WITH {_M5} SELECT request_id, user_id, doc_id, needed, allowed, reason FROM de"


def m6(spark, sf_dir):
    pairs = requests(spark, sf_dir).select("doc_id", "user_id").unionAll(grants(spark, sf_dir).select("doc_id", "user_id")).distinct()
    return access.effective(pairs, documents(spark, sf_dir), grants(spark, sf_dir))


M6 = f"""WITH {DOCS}, {GRANTS}, {REQUESTS}, p AS (SELECT doc_id, user_id FROM requests UNION SELECT doc_id, user_id FROM grants)
SELECT p.doc_id, p.user_id, CASE WHEN owner_id = p.user_id THEN 3 WHEN owner_id IS NOT NULL THEN permission END::INTEGER AS permission FROM p LEFT JOIN docs USING (doc_id) LEFT JOIN grants g ON g.doc_id = p.doc_id AND g.user_id = p.user_id"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that events ask for: the requests' users, levels 0 to 3, granted by user 5 at the event's time."""
    r = requests(spark, sf_dir)
    return r.select("doc_id", "user_id", (F.col("request_id") % 4).cast("int").alias("permission"), F.lit(5).cast("long").alias("granted_by"), F.col("at").alias("granted_at"))


_ASKED = 'asked AS (SELECT doc_id, user_id, CAST(request_id % 4 AS INTEGER) AS permission, 5 AS granted_by, "at" AS granted_at FROM requests)'


def m7(spark, sf_dir):
    after, rejected = access.grant(grants(spark, sf_dir), asked(spark, sf_dir), documents(spark, sf_dir))
    ok = after.select("doc_id", "user_id", "permission", F.lit("").alias("reason"), F.lit(1).cast("long").alias("n"))
    return ok.unionAll(rejected.groupBy("doc_id", "user_id", "permission", "reason").agg(F.count(F.lit(1)).alias("n")))


M7 = f"""WITH {DOCS}, {GRANTS}, {REQUESTS}, {_ASKED}, j AS (SELECT a.*, CASE WHEN d.doc_id IS NULL THEN 'unknown document' WHEN user_id = granted_by THEN 'Cannot share document with yourself' WHEN user_id = owner_id THEN 'Cannot share document with the owner'
  WHEN permission NOT BETWEEN 1 AND 3 THEN 'Invalid permission type' END AS reason FROM asked a LEFT JOIN docs d USING (doc_id)),
u AS (SELECT doc_id, user_id, permission, granted_at, 0 AS new_ FROM grants UNION ALL SELECT doc_id, user_id, permission, granted_at, 1 FROM j WHERE reason IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, user_id ORDER BY new_ DESC, granted_at DESC, permission DESC) AS rn FROM u)
SELECT doc_id, user_id, permission, '' AS reason, 1 AS n FROM l WHERE rn = 1 UNION ALL SELECT doc_id, user_id, permission, reason, count(*) FROM j WHERE reason IS NOT NULL GROUP BY ALL"""


def revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grants(spark, sf_dir).where("doc_id % 4 = 1")
    return g.select("doc_id", "user_id", F.lit(9).cast("long").alias("revoked_by"), F.timestamp_seconds(F.lit(1710000000)).alias("revoked_at"))


def m8(spark, sf_dir):
    return access.revoke(grants(spark, sf_dir), revoked(spark, sf_dir)).select("doc_id", "user_id", "permission")


M8 = f"WITH {GRANTS} SELECT doc_id, user_id, permission FROM grants WHERE doc_id % 4 <> 1"


def m9(spark, sf_dir):
    return access.listing(grants(spark, sf_dir), user_id=7).select("doc_id", "user_id", "permission", "granted_at")


M9 = f"WITH {GRANTS} SELECT doc_id, user_id, permission, granted_at FROM grants WHERE user_id = 7"


def m10(spark, sf_dir):
    users = documents(spark, sf_dir).groupBy(F.col("owner_id").alias("user_id")).agg(F.min("tenant_id").alias("tenant_id"))
    return access.shared_with(grants(spark, sf_dir), documents(spark, sf_dir), users)


M10 = f"WITH {DOCS}, {GRANTS}, us AS (SELECT owner_id AS user_id, min(tenant_id) AS tenant_id FROM docs GROUP BY 1) SELECT user_id, doc_id, permission, title FROM grants JOIN us USING (user_id) JOIN docs USING (doc_id, tenant_id)"


def m11(spark, sf_dir):
    asks = grants(spark, sf_dir).select("doc_id", "user_id", (1 + F.col("doc_id") % 3).cast("int").alias("needed"))
    return access.has_access(asks, grants(spark, sf_dir))


M11 = f"WITH {GRANTS} SELECT doc_id, user_id, CAST(1 + doc_id % 3 AS INTEGER) AS needed FROM grants WHERE permission >= 1 + doc_id % 3"


def m12(spark, sf_dir):
    """Three batches of audit rows, of which one is written twice, read back from the log."""
    path = scratch(spark, "audit")
    batches = {"grants": access.audit_rows(granted=grants(spark, sf_dir)), "revocations": access.audit_rows(revoked=revoked(spark, sf_dir)), "denied": access.audit_rows(decisions=decisions(spark, sf_dir))}
    for name in (*batches, "grants"):
        access.append_audit(batches[name], path, name)
    log = spark.read.schema(batches["grants"].schema).parquet(path)
    return log.groupBy("action", "actor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("doc_ids"), F.sum("permission").alias("permissions"))


M12 = f"""WITH {_M5}, a AS (SELECT 'GRANT_ACCESS' AS action, 0 AS actor_id, doc_id, permission FROM grants UNION ALL SELECT 'REVOKE_ACCESS', 9, doc_id, NULL FROM grants WHERE doc_id % 4 = 1 UNION ALL SELECT 'ACCESS_DENIED', user_id, doc_id, needed FROM de WHERE NOT allowed)
SELECT action, actor_id, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS doc_ids, CAST(sum(permission) AS BIGINT) AS permissions FROM a GROUP BY ALL"""


def n1(spark, sf_dir):
    return usage.system_stats(documents(spark, sf_dir), chunks(spark, sf_dir), table(spark, sf_dir, "events").where("event_type = 'view'"))


N1 = f"WITH {DOCS}, {CHUNKS} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM events WHERE event_type = 'view') AS queries, (SELECT max(updated_at) FROM docs) AS last_update"


def n2(spark, sf_dir):
    return usage.documents_per_tenant(documents(spark, sf_dir))


N2 = "SELECT source AS tenant_id, count(*) AS documents FROM documents GROUP BY source"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("props").alias("resource"), F.col("ts").alias("at"), "value")


def n3(spark, sf_dir):
    return usage.search_audit(audit_log(spark, sf_dir), action="ur", resource="1", number=2, size=10).select("id", "user_id", "action", "at", "total")


N3 = """SELECT id, user_id, action, "at", CAST(total AS INTEGER) AS total FROM (SELECT event_id AS id, user_id, event_type AS action, ts AS "at", count(*) OVER () AS total FROM events WHERE contains(event_type, 'ur') AND contains(props, '1')) ORDER BY "at" DESC, id DESC LIMIT 10 OFFSET 10"""


def n4(spark, sf_dir):
    e = audit_log(spark, sf_dir).withColumn("action", F.repeat("action", 30)).withColumn("resource", F.repeat("resource", 40)).withColumn("started_at", F.col("at")).withColumn("ended_at", F.expr("at + make_interval(0, 0, 0, 0, 0, 0, 0.25)"))
    s = usage.shape_audit(e, ["id", "user_id"])
    return s.select("id", "action", F.md5("resource").alias("resource_md5"), "details", "duration_ms")


N4 = """SELECT event_id AS id, substr(repeat(event_type, 30), 1, 100) AS action, md5(substr(repeat(props, 40), 1, 255)) AS resource_md5, '{"id":' || event_id || ',"user_id":' || user_id || '}' AS details, CAST(250 AS BIGINT) AS duration_ms FROM events"""


def quota_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 8 clients, of which the first is an administrator."""
    client = F.col("user_id") % 8
    return table(spark, sf_dir, "events").select(client.alias("client"), F.when(client == 0, "admin").otherwise("user").alias("role"), F.col("event_type").alias("endpoint"), F.col("ts").alias("at"))


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by role and endpoint, derived from what each role asks."""
    totals = quota_requests(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("c"))
    return totals.select("role", F.lit("*").alias("endpoint"), (F.col("c") / 200).cast("long").alias("quota")).unionAll(totals.select("role", F.lit("click").alias("endpoint"), (F.col("c") / 400).cast("long").alias("quota")))


def n6(spark, sf_dir):
    """Requests per day against quotas by role and endpoint."""
    return usage.over_quota(quota_requests(spark, sf_dir), quotas(spark, sf_dir), "1 day")


N6 = """WITH r AS (SELECT user_id % 8 AS client, CASE WHEN user_id % 8 = 0 THEN 'admin' ELSE 'user' END AS role, event_type AS endpoint, date_trunc('day', ts) AS start FROM events),
t AS (SELECT role, count(*) AS c FROM r GROUP BY role), l AS (SELECT role, '*' AS e, c // 200 AS quota FROM t UNION ALL SELECT role, 'click', c // 400 FROM t),
n AS (SELECT client, role, endpoint, start, count(*) AS n FROM r GROUP BY ALL), q AS (SELECT client, endpoint, start, n, min(quota) AS quota FROM n JOIN l USING (role) WHERE e = '*' OR e = endpoint GROUP BY ALL)
SELECT client, endpoint, CAST(start AS TIMESTAMP) AS start, n, quota FROM q WHERE n > quota"""

_NAMES = "m1_page m2_look_up m3_chunk_list m5_access_decision m6_effective_permission m7_grant m8_revoke m9_access_list m10_shared_with_me m11_has_access m12_access_audit n1_system_stats n2_documents_per_tenant n3_audit_search n4_audit_rows n6_quota".split()
QUERIES = dict(zip(_NAMES, (m1, m2, m3, m5, m6, m7, m8, m9, m10, m11, m12, n1, n2, n3, n4, n6)))
ORACLE_SQL = dict(zip(_NAMES, (M1, M2, M3, M5, M6, M7, M8, M9, M10, M11, M12, N1, N2, N3, N4, N6)))
