"""Memory requests: parsing, defaults, validation, and the episode and job that a valid one becomes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deterministic_id, present
from ..schemas import CREATE_MEMORY


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON bodies, one on a line, with the fields that the request schema knows."""
    return spark.read.schema(CREATE_MEMORY).json(path)


def parse_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """The body's fields beside the other columns; ``problem`` says why a request is refused, null if it is not."""
    parsed = bodies.withColumn("_r", F.from_json(F.col(column), CREATE_MEMORY)).withColumn("_bad", F.col("_r").isNull())
    fields = parsed.withColumns({
        "text": F.col("_r.text"), "namespace": F.coalesce("_r.namespace", F.lit("default")),
        "entity_key": F.col("_r.entityKey"), "session_id": F.col("_r.sessionId"),
    })
    problem = F.when(F.col("_bad"), F.lit("not a JSON object")).when(~present("text"), F.lit("text must have at least 1 character"))
    return fields.withColumn("problem", problem).drop("_r", "_bad", column)


def accept(requests: DataFrame, at: datetime) -> dict[str, DataFrame]:
    """Valid requests (tenant_id, user_id, request_id and the parsed fields) as ``episodes`` and ``jobs``; the rest as ``refused``.

    Both come from one projection and are written in one batch, so that no episode is left without its job.
    """
    valid = requests.where(F.col("problem").isNull()).withColumn("id", deterministic_id("episode", "tenant_id", "user_id", "request_id", "text"))
    return {
        "episodes": valid.select("id", F.col("text").alias("raw_text"), "user_id", "session_id", F.lit(at).cast("timestamp").alias("created_at")),
        "jobs": valid.select(
            F.col("id").alias("episodeId"), F.col("tenant_id").alias("tenantId"), "namespace", F.col("user_id").alias("userId"),
            F.col("entity_key").alias("entityKey"), F.col("session_id").alias("sessionId"), F.col("text").alias("rawText"),
        ),
        "refused": requests.where(F.col("problem").isNotNull()),
    }


def missing_episodes(jobs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Jobs whose episode is not stored."""
    return jobs.join(episodes.select(F.col("id").alias("episodeId")), "episodeId", "left_anti")


def require_episodes(jobs: DataFrame, episodes: DataFrame) -> DataFrame:
    """The jobs; an error that names the first missing episode, if there is one."""
    gone = missing_episodes(jobs, episodes).select("episodeId").head(1)
    if gone:
        raise LookupError(f"Episode not found: {gone[0].episodeId}")
    return jobs
