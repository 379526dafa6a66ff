"""Jobs arrive as files; each micro-batch retrieves, extracts, resolves and publishes once, however often it is retried."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import extraction, resolver, retrieval
from ..schemas import JOB
from ..sources import providers
from ..sources.requests import missing_episodes
from ..sources.store import Store


class Lifecycle(StreamingQueryListener):
    """Counts of started, finished and failed batches, for logs and tests."""

    def __init__(self, log: Callable[[str], None] = print):
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.log(f"started {event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.log(f"batch {event.progress.batchId}: {event.progress.numInputRows} jobs")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.log(f"idle {event.id}")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.log(f"{'failed' if event.exception else 'stopped'} {event.id}")


class Worker:
    """Applies jobs to a store. All that varies from run to run is injected: both providers and the clock.

    A batch sees the claims as they stood when it began. Its ids are functions of its episodes, and it is published
    under its own number, so a retried batch replaces itself. Records that can't be used go to quarantine.
    """

    def __init__(self, store: Store, extractor: providers.Extractor, embedder: providers.Embedder, clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None),
                 strict: bool = True, fold: bool = False, limit: int = retrieval.LIMIT):
        self.store, self.extractor, self.embedder, self.clock = store, extractor, embedder, clock
        self.strict, self.fold, self.limit = strict, fold, limit

    def process(self, jobs: DataFrame, batch_id: int) -> None:
        now = self.clock()
        jobs = jobs.dropDuplicates(["episodeId"]).withColumn("rawText", F.coalesce("rawText", F.lit("")))
        lost = missing_episodes(jobs, self.store.read("episodes", batch_id))
        jobs = jobs.join(lost.select("episodeId"), "episodeId", "left_anti").cache()
        # the order of episodes: their batch, then when they arrived
        arrived = self.store.read("episodes", batch_id).select(F.col("id").alias("episodeId"), F.col("created_at").alias("_at")).dropDuplicates(["episodeId"])
        order = F.lit(batch_id) * (1 << 32) + F.row_number().over(Window.partitionBy("tenantId").orderBy("_at", "episodeId"))
        episodes = jobs.join(arrived, "episodeId").select(
            F.col("episodeId").alias("episode_id"), F.col("tenantId").alias("tenant_id"), "namespace", F.col("userId").alias("user_id"), order.alias("seq"), F.col("rawText").alias("raw_text")
        )
        claims, vectors = self.store.claims(batch_id).cache(), self.store.read("vectors", batch_id)
        asked = providers.with_embedding(episodes.drop("seq"), "raw_text", self.embedder)
        found = retrieval.candidates_batch(asked, claims, vectors, self.limit).join(claims.select("id", "content", "kind", "recorded_at"), "id").cache()
        # the model is asked once for a batch: what it said is stored before anything follows from it
        responses = self.store.once(f"responses/batch_id={batch_id}", providers.with_extraction(retrieval.prompts(episodes, found), self.extractor))
        items = extraction.parse_responses(responses)
        scope = episodes.drop("raw_text")
        pending = extraction.pending_claims(items["claims"], jobs, now).join(scope.select("episode_id", "seq"), "episode_id").cache()
        out = resolver.resolve(items, pending, scope, claims, found.select("episode_id", "id"), self.store.read("entities", batch_id), now, self.strict, self.fold)
        kept = pending.join(out["removed"].select("id"), "id", "left_anti")
        new = kept.select("id", "content").unionByName(out["memory_claims"].select("id", "content"))
        table = claims.columns
        at = F.lit(now).cast("timestamp")
        bad = items["quarantine"].withColumn("at", at).unionByName(out["quarantine"])
        bad = bad.unionByName(lost.select(F.col("episodeId").alias("episode_id"), F.lit("job").alias("item"), F.lit(None).cast("int").alias("idx"), F.lit("Episode not found").alias("problem"), at.alias("at")))
        self.store.publish(batch_id, {
            "memory_claims": kept.select(*table).unionByName(out["memory_claims"].select(*table)),
            "vectors": extraction.vector_rows(providers.with_embedding(new, "content", self.embedder)),
            "quarantine": bad,
        } | {n: out[n] for n in ("claim_status_events", "memory_relationships", "evidence", "entities", "entity_relationships")})
        for df in (jobs, claims, found, pending):
            df.unpersist()

    def start(self, jobs_path: str, checkpoint: str, files: int = 100, once: bool = False) -> StreamingQuery:
        """The running query; ``stop()`` it to shut down after the batch at hand."""
        spark: SparkSession = self.store.spark
        stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", files).json(jobs_path)
        # batch 0 of the store is what was there before the stream
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.process(df, n + 1_000))
        return (writer.trigger(availableNow=True) if once else writer).start()


def claim_state_stream(events: DataFrame) -> DataFrame:
    """claim_id, status, seq of each claim so far, from a stream of status events; in update mode each batch tells what changed."""
    return events.groupBy("claim_id").agg(F.max(F.struct("seq", "status")).alias("e")).select("claim_id", "e.status", "e.seq")


def fold_status_files(events: DataFrame, folder: str) -> DataFrame:
    """Run a stream of status events (claim_id, status, seq) through what there is now; its state, as written below ``folder``."""
    query = (
        claim_state_stream(events).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/offsets")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return events.sparkSession.read.parquet(f"{folder}/state")


def enqueue(jobs: DataFrame, path: str) -> None:
    """Append jobs to the worker's folder."""
    jobs.write.mode("append").json(path)
