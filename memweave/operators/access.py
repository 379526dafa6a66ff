"""Organisations, membership, namespace permissions and provisioning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import default_email, deterministic_id, org_name, user_name
from ..functions.templates import NO_NAME

BYPASS = ("owner", "admin")


def point(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the values: the point lookups by id, membership or permission key."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def user_by_id(users: DataFrame, user_id: str) -> DataFrame:
    return point(users, id=user_id)


def user_orgs(memberships: DataFrame, orgs: DataFrame, user_id: str | None = None, org_id: str | None = None) -> DataFrame:
    """user_id, org_id, org_name, role, created_at of a user's organisations (or everyone's); small tables are broadcast by their size."""
    m = memberships
    for name, value in (("user_id", user_id), ("org_id", org_id)):
        if value is not None:
            m = m.where(F.col(name) == value)
    o = orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), "created_at")
    return m.join(o, "org_id").select("user_id", "org_id", "org_name", "role", "created_at")


def org_by_id(memberships: DataFrame, orgs: DataFrame, user_id: str, org_id: str) -> DataFrame:
    """The organisation if the user is a member; no row otherwise."""
    return user_orgs(memberships, orgs, user_id, org_id).limit(1)


def verified_membership(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests (user_id, tenant_id) whose tenant is given and has the user as a member, with the role."""
    m = memberships.select(F.col("user_id").alias("_u"), F.col("org_id").alias("_o"), "role")
    return requests.join(m, (F.col("user_id") == F.col("_u")) & (F.col("tenant_id") == F.col("_o"))).drop("_u", "_o")


def with_permission(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests (tenant_id, namespace, user_id, role) with may_read and may_write: owners and admins may, others need a grant."""
    p = permissions.select(F.col("org_id").alias("_o"), F.col("namespace").alias("_n"), F.col("user_id").alias("_u"), "can_read", "can_write")
    joined = requests.join(p, (F.col("tenant_id") == F.col("_o")) & (F.col("namespace") == F.col("_n")) & (F.col("user_id") == F.col("_u")), "left")
    bypass = F.coalesce(F.col("role").isin(*BYPASS), F.lit(False))
    may = {f"may_{what}": bypass | F.coalesce(F.col(f"can_{what}"), F.lit(False)) for what in ("read", "write")}
    return joined.withColumns(may).drop("_o", "_n", "_u", "can_read", "can_write")


def request_namespace(query: Column, body: Column) -> Column:
    """Where a request acts: the body's namespace, which is what gets written, then the query's, then ``default``."""
    return F.coalesce(F.nullif(body, F.lit("")), F.nullif(query, F.lit("")), F.lit("default"))


def gate(requests: DataFrame, memberships: DataFrame, permissions: DataFrame, what: str) -> DataFrame:
    """Requests with ``allowed``: members of the tenant with the right to ``what`` (read or write) in the namespace."""
    m = memberships.select(F.col("user_id").alias("_mu"), F.col("org_id").alias("_mo"), "role")
    member = requests.join(m, (F.col("user_id") == F.col("_mu")) & (F.col("tenant_id") == F.col("_mo")), "left")
    allowed = F.col("_mu").isNotNull() & F.col(f"may_{what}")
    return with_permission(member, permissions).withColumn("allowed", allowed).drop("_mu", "_mo", "may_read", "may_write")


def readable_namespaces(memberships: DataFrame, namespaces: DataFrame, permissions: DataFrame) -> DataFrame:
    """user_id, tenant_id, namespace of every namespace that a member may read; the others stay hidden."""
    every = memberships.join(namespaces, "org_id").select("user_id", F.col("org_id").alias("tenant_id"), "role", F.col("name").alias("namespace"))
    return with_permission(every, permissions).where("may_read").select("user_id", "tenant_id", "namespace")


def visible(claims: DataFrame, readable: DataFrame, reader: str) -> DataFrame:
    """Active claims in the namespaces that a user may read."""
    own = readable.where(F.col("user_id") == reader).select("tenant_id", "namespace")
    return claims.where(F.col("status") == "active").join(own, ["tenant_id", "namespace"], "left_semi")


def owner_violations(memberships: DataFrame) -> DataFrame:
    """org_id, owners of organisations that don't have exactly one owner."""
    return memberships.groupBy("org_id").agg(F.count_if(F.col("role") == "owner").alias("owners")).where("owners <> 1")


def provision(identities: DataFrame, users: DataFrame, at: datetime, unnamed: str = NO_NAME) -> dict[str, DataFrame]:
    """The rows that new identities (id, email, name, image) bring: user, own organisation, ownership, namespace and grant."""
    new = identities.dropDuplicates(["id"]).join(users.select("id"), "id", "left_anti").withColumn("org_id", deterministic_id("org", "id"))
    now = F.lit(at).cast("timestamp")
    return {
        "users": new.select("id", user_name(F.col("name"), unnamed).alias("name"), default_email(F.col("id"), F.col("email")).alias("email"), F.nullif("image", F.lit("")).alias("image"), now.alias("created_at"), now.alias("updated_at")),
        "orgs": new.select(F.col("org_id").alias("id"), org_name(F.col("name")).alias("name"), now.alias("created_at")),
    } | _ownership(new.select("org_id", F.col("id").alias("user_id")), now)


def _ownership(owners: DataFrame, now: Column) -> dict[str, DataFrame]:
    return {
        "org_memberships": owners.select("org_id", "user_id", F.lit("owner").alias("role"), now.alias("joined_at")),
        "namespaces": owners.select("org_id", F.lit("default").alias("name"), now.alias("created_at")),
        "namespace_permissions": grant(owners.withColumn("namespace", F.lit("default"))),
    }


def grant(rows: DataFrame, read: bool = True, write: bool = True) -> DataFrame:
    """Permission rows for (org_id, namespace, user_id)."""
    return rows.select("org_id", "namespace", "user_id", F.lit(read).alias("can_read"), F.lit(write).alias("can_write"))


def create_orgs(requests: DataFrame, at: datetime) -> dict[str, DataFrame]:
    """Organisations from (user_id, name), trimmed, with their owner, ``default`` namespace and grant; ``returning`` is what the caller sees."""
    now = F.lit(at).cast("timestamp")
    new = requests.withColumn("name", F.trim("name")).withColumn("org_id", deterministic_id("org", "user_id", "name", now))
    out = {"orgs": new.select(F.col("org_id").alias("id"), "name", now.alias("created_at"))} | _ownership(new.select("org_id", "user_id"), now)
    return out | {"returning": new.select("user_id", "org_id", F.col("name").alias("org_name"), F.lit("owner").alias("role"), now.alias("created_at"))}


def create_namespaces(requests: DataFrame, memberships: DataFrame, namespaces: DataFrame, at: datetime) -> dict[str, DataFrame]:
    """Namespaces from (org_id, user_id, name): owners and admins create; the creator gets a grant, other members nothing."""
    may = memberships.where(F.col("role").isin(*BYPASS)).select("org_id", "user_id")
    new = requests.join(may, ["org_id", "user_id"], "left_semi").join(namespaces.select("org_id", "name"), ["org_id", "name"], "left_anti")
    first = new.groupBy("org_id", "name").agg(F.min("user_id").alias("user_id"))
    return {
        "namespaces": first.select("org_id", "name", F.lit(at).cast("timestamp").alias("created_at")),
        "namespace_permissions": grant(first.withColumnRenamed("name", "namespace")),
    }


def sync_profiles(users: DataFrame, identities: DataFrame, at: datetime) -> DataFrame:
    """All users, with the fields that an identity supplies and that differ; ``updated_at`` moves only where something changed."""
    new = identities.dropDuplicates(["id"]).select("id", *[F.nullif(c, F.lit("")).alias(f"_{c}") for c in ("name", "email", "image")])
    differs = {c: F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("name", "email", "image")}
    changed = differs["name"] | differs["email"] | differs["image"]
    return users.join(new, "id", "left").select(
        "id", *[F.when(differs[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "email", "image")],
        "created_at", F.when(changed, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
