"""Access lists: decisions, grants, revocations and their audit. Permissions are ranks: 1 read, 2 write, 3 admin.

Tables: documents (doc_id, tenant_id, owner_id, is_public), grants (doc_id, user_id, permission, granted_at; unique by document and
user), requests (doc_id, user_id, tenant_id, needed), admins (user_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.common import sized

READ, WRITE, ADMIN = 1, 2, 3
#: Actions of the access audit.
GRANT_ACCESS, REVOKE_ACCESS, ACCESS_DENIED = "GRANT_ACCESS", "REVOKE_ACCESS", "ACCESS_DENIED"


def decide(requests: DataFrame, documents: DataFrame, grants: DataFrame, admins: DataFrame) -> DataFrame:
    """``requests`` with allowed and reason. In order: admin role, unknown document, other tenant, owner, grant, public read, none."""
    docs = documents.select("doc_id", F.col("tenant_id").alias("_tenant"), F.col("owner_id").alias("_owner"), F.col("is_public").alias("_public"))
    rows = requests.join(docs.hint("merge"), "doc_id", "left").join(grants.select("doc_id", "user_id", F.col("permission").alias("_granted")).hint("merge"), ["doc_id", "user_id"], "left")
    rows = rows.join(sized(admins.select("user_id", F.lit(True).alias("_admin")).distinct()), "user_id", "left")
    reason = (
        F.when(F.col("user_id").isNull(), "no user").when(F.col("_admin"), "admin").when(F.col("_tenant").isNull(), "not found")
        .when(F.col("tenant_id").isNull() | (F.col("_tenant") != F.col("tenant_id")), "other tenant").when(F.col("_owner") == F.col("user_id"), "owner")
        .when(F.col("_granted") >= F.col("needed"), "granted").when(F.col("_public") & (F.col("needed") == READ), "public").otherwise("no permission")
    )
    rows = rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isin("admin", "owner", "granted", "public"))
    return rows.drop("_tenant", "_owner", "_public", "_granted", "_admin")


def effective(pairs: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """(doc_id, user_id, permission): admin for the owner, else the grant, else null; tenant, public flag and roles play no part."""
    rows = pairs.join(documents.select("doc_id", "owner_id").hint("merge"), "doc_id", "left").join(grants.select("doc_id", "user_id", "permission").hint("merge"), ["doc_id", "user_id"], "left")
    own = F.when(F.col("owner_id") == F.col("user_id"), ADMIN)
    return rows.select("doc_id", "user_id", F.when(F.col("owner_id").isNotNull(), F.coalesce(own, F.col("permission"))).alias("permission"))


def grant(grants: DataFrame, asked: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grants after the upsert, rejected with reason). ``asked``: doc_id, user_id, permission, granted_by, granted_at; later ones replace
    earlier ones. Sharing with oneself or the owner and unknown levels are refused."""
    rows = asked.join(documents.select("doc_id", F.col("owner_id").alias("_owner")).hint("merge"), "doc_id", "left")
    reason = (
        F.when(F.col("_owner").isNull(), "unknown document").when(F.col("user_id") == F.col("granted_by"), "Cannot share document with yourself")
        .when(F.col("user_id") == F.col("_owner"), "Cannot share document with the owner").when(F.coalesce(F.col("permission").between(READ, ADMIN), F.lit(False)) == F.lit(False), "Invalid permission type")
    )
    rows = rows.withColumn("reason", reason).drop("_owner")
    columns = ["doc_id", "user_id", "permission", "granted_by", "granted_at"]
    both = grants.select(*columns, F.lit(0).alias("_new")).unionByName(rows.where("reason is null").select(*columns, F.lit(1).alias("_new")))
    order = W.partitionBy("doc_id", "user_id").orderBy(F.desc("_new"), F.desc("granted_at"), F.desc("permission"))
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new"), rows.where("reason is not null")


def revoke(grants: DataFrame, asked: DataFrame) -> DataFrame:
    return grants.join(sized(asked.select("doc_id", "user_id").distinct()), ["doc_id", "user_id"], "left_anti")


def listing(grants: DataFrame, doc_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """Grants of a document or a user, newest first."""
    rows = grants if doc_id is None else grants.where(F.col("doc_id") == doc_id)
    rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("granted_at"), "doc_id", "user_id")


def shared_with(grants: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, doc_id, permission, title): each user's grants on documents of the own tenant. ``users``: user_id, tenant_id."""
    own = grants.join(sized(users.select("user_id", "tenant_id")), "user_id")
    return own.join(documents.select("doc_id", "tenant_id", "title").hint("merge"), ["doc_id", "tenant_id"]).select("user_id", "doc_id", "permission", "title")


def has_access(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """The requests whose grant exists and suffices."""
    g = grants.select(F.col("doc_id").alias("_d"), F.col("user_id").alias("_u"), F.col("permission").alias("_p"))
    return requests.join(g.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("user_id") == F.col("_u")) & (F.col("_p") >= F.col("needed")), "left_semi")


def audit_rows(granted: DataFrame | None = None, revoked: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """(actor_id, action, doc_id, target_id, permission, at) of grants (granted_by), revocations (revoked_by, revoked_at) and denied requests (at)."""
    parts = []
    if granted is not None:
        parts.append(granted.select(F.col("granted_by").alias("actor_id"), F.lit(GRANT_ACCESS).alias("action"), "doc_id", F.col("user_id").alias("target_id"), "permission", F.col("granted_at").alias("at")))
    if revoked is not None:
        parts.append(revoked.select(F.col("revoked_by").alias("actor_id"), F.lit(REVOKE_ACCESS).alias("action"), "doc_id", F.col("user_id").alias("target_id"), F.lit(None).cast("int").alias("permission"), F.col("revoked_at").alias("at")))
    if decisions is not None:
        parts.append(decisions.where("not allowed").select(F.col("user_id").alias("actor_id"), F.lit(ACCESS_DENIED).alias("action"), "doc_id", F.col("user_id").alias("target_id"), F.col("needed").alias("permission"), "at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_audit(rows: DataFrame, path: str, batch: str) -> None:
    """Add :func:`audit_rows` to the log at ``path``; a batch that is written again replaces what it wrote."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
