"""Claim and entity graphs: edge lifecycle, reads as of a time, lineage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Relations that end when their claim is superseded; those of history (UPDATES, DERIVES) never do, the others stay too.
CLOSING = ("SUPPORTS", "CONTRADICTS")


def close_edges(edges: DataFrame, superseded: DataFrame, at: datetime | Column) -> DataFrame:
    """All edges; open SUPPORTS and CONTRADICTS edges of a superseded claim (id) get ``tx_expired_at``. Off unless called."""
    gone = superseded.select(F.col("id").alias("_id")).distinct()
    ends = edges.where(F.col("relation").isin(*CLOSING) & F.col("tx_expired_at").isNull()).select("id", F.explode(F.array("source_claim_id", "target_claim_id")).alias("_id"))
    hit = ends.join(gone, "_id", "left_semi").select("id").distinct().withColumn("_hit", F.lit(True))
    when = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    return edges.join(hit, "id", "left").withColumn("tx_expired_at", F.when(F.col("_hit"), when).otherwise(F.col("tx_expired_at"))).drop("_hit")


def as_of(rows: DataFrame, valid: Column, known: Column) -> DataFrame:
    """Rows valid at one time as known at another: half-open intervals, null ends are open."""
    for begin, end, t in (("valid_at", "invalid_at", valid), ("tx_created_at", "tx_expired_at", known)):
        rows = rows.where((F.col(begin) <= t) & (F.col(end).isNull() | (F.col(end) > t)))
    return rows


def with_closing_time(events: DataFrame, key: list[str], at: str = "ts", order: str = "event_id") -> DataFrame:
    """Each row with ``invalid_at``, the time of the key's next row."""
    return events.withColumn("invalid_at", F.lead(at).over(Window.partitionBy(*key).orderBy(at, order)))


def lineage(edges: DataFrame, start: DataFrame, relations: tuple[str, ...] = ("UPDATES", "DERIVES"), hops: int = 4) -> DataFrame:
    """root, id, depth: claims reachable from each start (id) along the relations, at their least depth, however far.

    A round goes ``hops`` steps from where the last one ended and is written; claims that were reached are not
    visited again, so loops end, and with them the rounds.
    """
    hop = edges.where(F.col("relation").isin(*relations)).where("source_claim_id <> target_claim_id")
    hop = written(hop.select(F.col("source_claim_id").alias("id"), F.col("target_claim_id").alias("next")).distinct())
    seen = written(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    front, depth = seen, 0
    while True:
        step, found = front.select("root", "id"), None
        for d in range(depth + 1, depth + hops + 1):
            step = step.join(hop, "id").select("root", F.col("next").alias("id")).distinct()
            own = step.withColumn("depth", F.lit(d))
            found = own if found is None else found.unionByName(own)
        least = found.groupBy("root", "id").agg(F.min("depth").alias("depth"))
        new = written(least.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        depth += hops
        seen = seen.unionByName(new)
        front = new.where(F.col("depth") == depth)
        if not front.head(1):
            return seen


def crossing_edges(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges whose ends are in different namespaces, which the model forbids."""
    ns = claims.select("id", F.concat_ws("/", "tenant_id", "namespace").alias("ns"))
    a, b = ns.select(F.col("id").alias("source_claim_id"), F.col("ns").alias("_a")), ns.select(F.col("id").alias("target_claim_id"), F.col("ns").alias("_b"))
    return edges.join(a, "source_claim_id").join(b, "target_claim_id").where("_a <> _b").drop("_a", "_b")
