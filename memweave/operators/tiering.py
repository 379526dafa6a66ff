"""Hot, warm and cold tiers as a partition column; sweeps, export, rehydration and session expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tiers(claims: DataFrame, last_access: DataFrame, readable: DataFrame, now: datetime, idle_days: int) -> DataFrame:
    """Claims with ``tier``: warm after ``idle_days`` without access (id, accessed_at), else hot.

    Namespaces with more than one reader stay hot however old their claims are.
    """
    shared = readable.groupBy("tenant_id", "namespace").agg(F.count_distinct("user_id").alias("_readers"))
    seen = last_access.groupBy("id").agg(F.max("accessed_at").alias("_at"))
    t = F.lit(now).cast("timestamp")
    idle = F.coalesce("_at", "recorded_at") < t - F.make_dt_interval(F.lit(idle_days))
    joined = claims.join(seen, "id", "left").join(shared, ["tenant_id", "namespace"], "left")
    return joined.withColumn("tier", F.when(idle & (F.coalesce("_readers", F.lit(0)) <= 1), "warm").otherwise("hot")).select(*claims.columns, "tier")


def export_cold(claims: DataFrame, chosen: Column, path: str) -> DataFrame:
    """Write the chosen claims as cold, by tenant; the claims that stay are returned. Run again, it writes the same."""
    cold = claims.where(F.coalesce(chosen, F.lit(False))).withColumn("tier", F.lit("cold"))
    cold.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "tenant_id").parquet(path)
    return claims.where(~F.coalesce(chosen, F.lit(False)))


def rehydrate(spark: SparkSession, hot: DataFrame, path: str, tenant_id: str) -> DataFrame:
    """Hot claims and one tenant's cold ones; only that tenant's files are read."""
    cold = spark.read.parquet(path).where((F.col("tier") == "cold") & (F.col("tenant_id") == tenant_id))
    return hot.unionByName(cold.select(*[F.col(c).cast(t).alias(c) for c, t in hot.dtypes]))


def expire_sessions(claims: DataFrame, now: datetime, ttl_hours: int, promoted: DataFrame | None = None) -> DataFrame:
    """Claims without those of sessions that were quiet for ``ttl_hours``; promoted claims (id) lose their session and stay."""
    if promoted is not None:
        p = promoted.select("id").distinct().withColumn("_p", F.lit(True))
        claims = claims.join(p, "id", "left").withColumn("session_id", F.when(F.col("_p").isNull(), F.col("session_id"))).drop("_p")
    last = claims.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max("recorded_at").alias("_last"))
    old = last.where(F.col("_last") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))).select("session_id")
    return claims.join(old, "session_id", "left_anti")
