"""The memory model's tables, read off the benchmark tables by fixed rules.

documents are claims (lang the namespace, source the tenant), labels their status, embeddings their vectors,
conversations episodes, events a log of mutations and quintuplets, customers members of their nation's organisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality").isNull(), "pending_review").when((F.col("quality") == 1) & (F.col("toxic") == 0), "active").otherwise("superseded")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), F.col("lang").alias("namespace"), (F.col("doc_id") % 2).alias("user_id"),
        F.col("text").alias("content"), F.lit("fact").alias("kind"), status.alias("status"), F.col("doc_id").alias("recorded_at"),
    )


def hashed(claims: DataFrame) -> DataFrame:
    return claims.withColumn("content_hash", content_hash("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("memory_claim").alias("entity_type"), F.col("vec_id").alias("entity_id"), "embedding")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_custkey") % 25 == 0, "owner").when(F.col("c_custkey") % 7 == 0, "admin").otherwise("member")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"), role.alias("role"))


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("created_at"))


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some members have a row, with reading, writing, both or neither."""
    m = memberships(spark, sf_dir).where(F.col("user_id") % 3 == 0)
    return m.select("org_id", F.lit("default").alias("namespace"), "user_id", (F.col("user_id") % 2 == 0).alias("can_read"), (F.col("user_id") % 4 == 0).alias("can_write"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each event: from its number to half of it, valid from its time until the user's next event of the type."""
    from ..operators.graph import with_closing_time

    names = {"signup": "DERIVES", "purchase": "UPDATES", "view": "SUPPORTS", "click": "CONTRADICTS"}
    relation = F.lit("MENTIONS")
    for k, v in names.items():
        relation = F.when(F.col("event_type") == k, v).otherwise(relation)
    e = with_closing_time(events(spark, sf_dir), ["user_id", "event_type"])
    return e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("source_claim_id"), F.expr("event_id div 2").alias("target_claim_id"), relation.alias("relation"),
        F.col("ts").alias("valid_at"), "invalid_at", F.col("ts").alias("tx_created_at"), F.lit(None).cast("timestamp_ntz").alias("tx_expired_at"),
    )
