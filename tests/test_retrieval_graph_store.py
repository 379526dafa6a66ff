"""Retrieval, graph, deletes, tiers, the store and the streaming worker."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from memweave.operators import graph, retrieval, status, tiering
from memweave.schemas import JOB
from memweave.sources import providers
from memweave.sources.store import Store
from memweave.streaming import Worker
from memweave.streaming.worker import enqueue

NOW = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def claims(spark):
    rows = [("a", "active", 1), ("b", "active", 2), ("c", "active", 3), ("d", "superseded", 9), ("e", "active", 4)]
    df = spark.createDataFrame(rows, "id string, status string, recorded_at bigint")
    return df.withColumns({"tenant_id": F.lit("t"), "namespace": F.lit("n"), "user_id": F.lit("u"), "content": F.concat(F.lit("text "), "id"), "kind": F.lit("fact")})


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("a", [1.0, 0.0], "memory_claim"), ("b", [-1.0, 0.0], "memory_claim"), ("d", [1.0, 0.0], "memory_claim"), ("c", [1.0, 0.0], "entity")]
    return spark.createDataFrame(rows, "entity_id string, embedding array<float>, entity_type string")


def test_claims_without_vector_stand_between(spark, claims, vectors):
    q = F.array(F.lit(1.0), F.lit(0.0))
    got = retrieval.candidates(claims, vectors, "t", "n", "u", q)
    assert [r.id for r in got.collect()] == ["a", "e", "c", "b"] and got.columns == ["id", "content", "kind", "recorded_at"]
    assert [r.id for r in retrieval.candidates(claims, vectors, "t", "n", "u", q, limit=2).collect()] == ["a", "e"]
    assert retrieval.candidates(claims, vectors, "t", "other", "u", q).count() == 0
    assert "TakeOrdered" in got._jdf.queryExecution().executedPlan().toString()


def test_batch_agrees_with_single_queries(spark, claims, vectors):
    ep = spark.createDataFrame([("e1", "t", "n", "u", [1.0, 0.0]), ("e2", "t", "n", "u", [-1.0, 0.0])], "episode_id string, tenant_id string, namespace string, user_id string, embedding array<float>")
    got = retrieval.candidates_batch(ep, claims, vectors, 3).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.episode_id, r["rank"]))] == ["a", "e", "c", "b", "e", "c"]
    p = {r.episode_id: json.loads(r.candidates) for r in retrieval.prompts(ep.select("episode_id", F.lit("x").alias("raw_text")), retrieval.candidates_batch(ep, claims, vectors, 1).join(claims.select("id", "content", "kind", "recorded_at"), "id")).collect()}
    assert p["e2"] == [{"id": "b", "content": "text b", "kind": "fact", "recordedAt": 2}]


def test_text_scores_prefer_rare_words(spark):
    c = spark.createDataFrame([("a", "the cat"), ("b", "the the dog"), ("c", "the bird")], "id string, content string")
    got = {r.id: r.text_score for r in retrieval.text_scores(c, "The CAT!").collect()}
    assert max(got, key=got.get) == "a" and set(got) == {"a", "b", "c"}


def test_edges_close_and_lineage_ends_in_loops(spark):
    e = spark.createDataFrame([("1", "a", "b", "SUPPORTS"), ("2", "b", "c", "UPDATES"), ("3", "c", "b", "DERIVES"), ("4", "a", "b", "UPDATES")], "id string, source_claim_id string, target_claim_id string, relation string")
    e = e.withColumn("tx_expired_at", F.lit(None).cast("timestamp"))
    closed = graph.close_edges(e, spark.createDataFrame([("b",)], "id string"), NOW)
    assert {r.id for r in closed.collect() if r.tx_expired_at} == {"1"}
    got = {tuple(r) for r in graph.lineage(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)}


def test_as_of_is_half_open(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, t(1), t(3), t(1), None), (2, t(3), None, t(1), t(2))], "id int, valid_at timestamp, invalid_at timestamp, tx_created_at timestamp, tx_expired_at timestamp")
    at = lambda v, k: [r.id for r in graph.as_of(rows, F.lit(t(v)).cast("timestamp"), F.lit(t(k)).cast("timestamp")).collect()]
    assert at(1, 5) == [1] and at(3, 5) == [] and at(3, 1) == [2]


def test_cascades_and_deletes(spark):
    c = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "b")], "id string, source_claim_id string, target_claim_id string")
    left = status.cascade_delete({"memory_claims": c, "memory_relationships": e}, "memory_claims", spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in left["memory_claims"].collect()] == ["b"] and [r.id for r in left["memory_relationships"].collect()] == ["2"]
    n = spark.createDataFrame([("x",), (None,), ("y",)], "v string")
    assert {r.v for r in status.delete_where_in(n, "v", ["x"]).collect()} == {None, "y"}
    assert {r.v for r in n.where(status.like_any(F.col("v"), ["x", "q"])).collect()} == {"x"}


def test_tiers_export_and_rehydrate(spark, claims, tmp_path):
    old = datetime.datetime(2024, 1, 1)
    c = claims.withColumn("recorded_at", F.when(F.col("id") == "a", F.lit(NOW)).otherwise(F.lit(old))).withColumn("session_id", F.when(F.col("id").isin("a", "b"), F.col("id")))
    seen = spark.createDataFrame([("c", NOW)], "id string, accessed_at timestamp")
    one = spark.createDataFrame([("t", "n", "u")], "tenant_id string, namespace string, user_id string")
    assert {r.id for r in tiering.tiers(c, seen, one, NOW, 30).where("tier = 'warm'").collect()} == {"b", "d", "e"}
    two = one.unionByName(one.withColumn("user_id", F.lit("v")))
    assert tiering.tiers(c, seen, two, NOW, 30).where("tier = 'warm'").count() == 0
    stay = tiering.export_cold(c, F.col("status") == "superseded", str(tmp_path / "cold"))
    assert stay.count() == 4
    assert {r.id for r in tiering.rehydrate(spark, stay, str(tmp_path / "cold"), "t").collect()} == {"a", "b", "c", "d", "e"}
    assert {r.id for r in tiering.expire_sessions(c, NOW, 24).collect()} == {"a", "c", "d", "e"}
    assert {r.id for r in tiering.expire_sessions(c, NOW, 24, spark.createDataFrame([("b",)], "id string")).collect()} == {"a", "b", "c", "d", "e"}


def test_latest_status_wins(spark):
    ev = spark.createDataFrame([("a", "active", 1), ("a", "superseded", 2), ("b", "active", 5)], "claim_id string, status string, seq bigint")
    assert {(r.claim_id, r.status) for r in status.latest_status(ev).collect()} == {("a", "superseded"), ("b", "active")}


class Script:
    """An extractor that answers from a fixed table."""

    def __init__(self, answers):
        self.answers = answers

    def extract(self, text, candidates):
        return self.answers.get(text) or providers.SentenceExtractor().extract(text, candidates)


def test_worker_resolves_once_and_a_replay_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ep = spark.createDataFrame([(f"e{i}", t, "u", None, NOW) for i, t in enumerate(["User uses Bun.", "user uses bun. User runs.", "broken"])], "id string, raw_text string, user_id string, session_id string, created_at timestamp")
    store.publish(1, {"episodes": ep})
    jobs = ep.select(F.col("id").alias("episodeId"), F.lit("t").alias("tenantId"), F.lit("default").alias("namespace"), F.col("user_id").alias("userId"), F.lit(None).cast("string").alias("entityKey"), F.lit(None).cast("string").alias("sessionId"), F.col("raw_text").alias("rawText"))
    gone = jobs.limit(1).withColumn("episodeId", F.lit("lost"))
    enqueue(jobs.unionByName(gone), str(tmp_path / "jobs"))
    w = Worker(store, Script({"broken": "{"}), providers.HashEmbedder(8), clock=lambda: NOW, fold=True)
    q = w.start(str(tmp_path / "jobs"), str(tmp_path / "checkpoint"), once=True)
    assert q.awaitTermination(600) and q.exception() is None

    def state():
        got = sorted((r.id, r.content.lower(), r.status) for r in store.claims().collect())
        return got, sorted(r.problem for r in store.read("quarantine").collect()), store.read("vectors").count(), store.read("evidence").count()

    first = state()
    assert sorted((c, s) for _, c, s in first[0]) == [("user runs.", "active"), ("user uses bun.", "active")]
    assert first[1:] == (["Episode not found", "not a record"], 2, 3)
    w.process(spark.read.schema(JOB).json(str(tmp_path / "jobs")), 1_000)  # the same batch again
    assert state() == first


@pytest.mark.parametrize("fold", [False, True])
def test_worker_takes_messages_in_the_order_they_arrived(spark, tmp_path, fold):
    """The later message updates what the earlier one said, whatever their ids are."""
    store = Store(spark, str(tmp_path / "store"))
    at = lambda m: NOW + datetime.timedelta(minutes=m)
    ep = spark.createDataFrame([(i, t, "u", None, at(m)) for i, t, m in [("z", "I use Bun.", 0), ("a", "i use bun.", 1), ("m", "I run.", 2)]], "id string, raw_text string, user_id string, session_id string, created_at timestamp")
    store.publish(1, {"episodes": ep})
    job = ep.select(F.col("id").alias("episodeId"), F.lit("t").alias("tenantId"), F.lit("default").alias("namespace"), F.col("user_id").alias("userId"), F.lit(None).cast("string").alias("entityKey"), F.lit(None).cast("string").alias("sessionId"), F.col("raw_text").alias("rawText"))
    Worker(store, Script({}), providers.HashEmbedder(4), clock=lambda: NOW, fold=fold).process(job, 2)
    assert {(r.content, r.status) for r in store.claims().collect()} == {("I use Bun.", "active"), ("I run.", "active")}
    assert {r.claim_id for r in store.read("evidence").where("episode_id = 'a'").collect()} == {r.id for r in store.claims().where("content = 'I use Bun.'").collect()}


def test_compaction_shows_every_row_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n in range(1, 5):
        store.publish(n, {"episodes": spark.createDataFrame([(f"e{n}", "x", "u", None, NOW)], "id string, raw_text string, user_id string, session_id string, created_at timestamp")})
    store.compact()
    assert store.batches() == [3, 4]
    assert sorted(r.id for r in store.read("episodes").collect()) == ["e1", "e2", "e3", "e4"]
    assert sorted(r.id for r in store.read("episodes", 4).collect()) == ["e1", "e2", "e3"]
    store.compact()
    assert store.batches() == [3, 4] and store.read("episodes").count() == 4


def test_json_containment_tells_types_apart(spark):
    rows = [('{"a.b": 7, "n": {"x": true, "y": [1]}, "s": "7"}',), ('{"a.b": "7", "n": {"x": "true"}}',), ("not json",), (None,), ('{"a.b": null}',)]
    df = spark.createDataFrame(rows, "metadata string").withColumn("i", F.monotonically_increasing_id())
    at = lambda **w: sorted(rows.index((r.metadata,)) for r in df.where(retrieval.contains_json(F.col("metadata"), w)).collect())
    assert at(**{"a.b": 7}) == [0] and at(**{"a.b": "7"}) == [1] and at(**{"a.b": None}) == [4]
    assert at(n={"x": True}) == [0] and at(n={"x": "true"}) == [1] and at(s="7", **{"a.b": 7.0}) == [0]


def test_all_ranks_of_a_distributed_sort(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: -r[1]))}
    assert {r.id: r["rank"] for r in retrieval.ranked(df, F.col("v").desc()).collect()} == want
    assert {r.id for r in retrieval.ranked(df, F.col("v").desc(), limit=5).collect()} == {i for i, k in want.items() if k <= 5}


def test_lineage_has_no_last_step(spark):
    e = spark.createDataFrame([(f"{i}", f"{i + 1}", "UPDATES") for i in range(12)] + [("12", "3", "DERIVES"), ("5", "5", "UPDATES")], "source_claim_id string, target_claim_id string, relation string")
    got = {r.id: r.depth for r in graph.lineage(e, spark.createDataFrame([("0",)], "id string"), hops=3).collect()}
    assert got == {str(i): i for i in range(13)}
