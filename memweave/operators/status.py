"""Claim status as a fold over appended events, and deletes as anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS, REFERENCES


def latest_status(events: DataFrame) -> DataFrame:
    """claim_id, status, seq of each claim's last event; partial aggregation keeps one row for each claim and task."""
    last = F.max(F.struct("seq", "status"))
    return events.groupBy("claim_id").agg(last.alias("_e")).select("claim_id", "_e.status", "_e.seq")


def current_claims(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Claims with the status of their last event, or their own without one."""
    last = events.groupBy(F.col("claim_id").alias("id")).agg(F.max(F.struct("seq", "status", "at")).alias("_e"))
    joined = claims.join(last, "id", "left")
    return joined.withColumns({"status": F.coalesce("_e.status", "status"), "updated_at": F.coalesce("_e.at", "updated_at")}).drop("_e").select(*claims.columns)


def active(claims: DataFrame) -> DataFrame:
    """What any reader may see: active claims only."""
    return claims.where(F.col("status") == "active")


def drop_duplicates_of(claims: DataFrame, vectors: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and vectors without those of removed claims (id)."""
    gone = removed.select("id")
    own = vectors.join(gone, (vectors["entity_id"] == gone["id"]) & (vectors["entity_type"] == "memory_claim"), "left_anti")
    return claims.join(gone, "id", "left_anti"), own


def delete_where_in(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is not among the values; a row with null stays."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_anti").select(*df.columns)
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def like_any(c: Column, prefixes: list[str]) -> Column:
    """Whether a text begins with any of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return found


def cascade_delete(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All given tables after deleting rows (id) of one: children go with their parents, one anti join for each reference."""
    left = dict(tables)
    todo = [(table, gone.select("id").distinct())]
    while todo:
        name, ids = todo.pop(0)
        left[name] = left[name].join(ids, "id", "left_anti").select(*tables[name].columns)
        for child, column, parent in REFERENCES:
            if parent == name and child in left:
                hit = left[child].join(ids.select(F.col("id").alias(column)), column, "left_semi")
                if "id" in left[child].columns:
                    todo.append((child, hit.select("id").distinct()))
                else:
                    left[child] = left[child].join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*tables[child].columns)
    return left


def unique_violations(df: DataFrame, table: str) -> DataFrame:
    """Keys of a table that occur more than once."""
    return df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")


def reference_violations(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose reference is not null and has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)), column, "left_anti")
