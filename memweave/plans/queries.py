"""The registered queries of the memory model, each over its whole tables, by the library's operators."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content_hash, js_trim, present, structured_attributes, utf16_slice
from ..operators import access, graph, retrieval, status
from ..operators.extraction import ITEMS, parse_responses
from ..operators.resolver import decide_round, first_writer, resolve
from ..sources.scratch import shared_folder
from ..streaming import fold_status_files
from . import model

TENANT, NAMESPACE, USER, QUERY = "src1", "en", 1, 0


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY).select(F.col("embedding").alias("query"))


def candidate_topk(spark: SparkSession, sf_dir: str, limit: int = retrieval.LIMIT) -> DataFrame:
    """The ten claims nearest to a vector among all active English ones."""
    found = model.claims(spark, sf_dir).where((F.col("namespace") == NAMESPACE) & (F.col("status") == "active")).drop("content")
    asked = found.join(F.broadcast(_query_vector(spark, sf_dir)))  # one row
    top = retrieval.nearest(retrieval.with_distance(asked, model.vectors(spark, sf_dir), F.col("query"), 6), limit)
    by = Window.orderBy("distance", F.col("recorded_at").desc(), "id")
    return top.withColumn("rank", F.row_number().over(by)).select("id", "kind", "recorded_at", "rank")


def candidate_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one tenant, namespace and user."""
    found = retrieval.in_scope(model.claims(spark, sf_dir), TENANT, NAMESPACE, USER)
    top = retrieval.nearest(retrieval.with_distance(found.join(F.broadcast(_query_vector(spark, sf_dir))), model.vectors(spark, sf_dir), F.col("query"), 6))
    return top.select("id", "kind", "recorded_at", js_trim("content").alias("content"))


def candidate_topk_per_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest claims of its scope for every claim with a vector, taken as an episode."""
    c = model.claims(spark, sf_dir).drop("content")
    v = model.vectors(spark, sf_dir)
    episodes = c.join(v, c["id"] == v["entity_id"]).select(F.col("id").alias("episode_id"), "tenant_id", "namespace", "user_id", "embedding")
    return retrieval.candidates_batch(episodes, c, v, digits=6).select("episode_id", "id", F.col("rank").cast("long").alias("rank"))


def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each vector whose id is divisible by 20, by blocks."""
    e = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    return retrieval.candidates_blocked(q, e).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def missing_vector_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each namespace, active claims nearer than, as far as, and farther than a claim without a vector."""
    found = status.active(model.claims(spark, sf_dir)).drop("content").join(F.broadcast(_query_vector(spark, sf_dir)))
    d = retrieval.with_distance(found, model.vectors(spark, sf_dir), F.col("query"), 6)
    return d.groupBy("namespace").agg(F.count_if(F.col("distance") < 1).alias("nearer"), F.count_if(F.col("distance") == 1).alias("unknown"), F.count_if(F.col("distance") > 1).alias("farther"))


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving claim of each content hash in a namespace."""
    c = model.hashed(model.claims(spark, sf_dir).select("id", "namespace", "content"))
    return c.groupBy("namespace", "content_hash").agg(F.min("id").alias("survivor"), F.count("*").alias("n"))


def dedupe_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pending claim resolved against the active ones of its tenant, namespace and user: activated, or a duplicate and of which."""
    c = model.hashed(model.claims(spark, sf_dir))
    scope = ["tenant_id", "namespace", "user_id"]
    p = c.where("status = 'pending_review'").withColumn("episode_id", F.concat_ws("/", *scope)).withColumn("idx", F.col("id"))
    p = p.withColumn("id", F.lpad(F.col("id").cast("string"), 20, "0"))
    active = c.where("status = 'active'").select(F.lpad(F.col("id").cast("string"), 20, "0").alias("id"), *scope, "content_hash")
    none = spark.createDataFrame([], "episode_id string, tenant_id string, namespace string, user_id bigint, seq bigint, idx int, target string, text string, hash string")
    d = decide_round(none, p, active)
    return d.select(F.col("id").cast("long").alias("id"), F.col("what").alias("decision"), F.coalesce("other", "id").cast("long").alias("kept"))


def active_visible_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = status.active(model.claims(spark, sf_dir))
    return c.select("id", "tenant_id", "namespace", "user_id", F.length("content").cast("long").alias("chars"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.claims(spark, sf_dir).groupBy("tenant_id", "namespace", "status").agg(F.count("*").alias("n"))


def latest_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as a claim's status."""
    e = model.events(spark, sf_dir).select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return status.latest_status(e)


def streaming_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over the events' files, run to their end."""
    e = spark.readStream.schema(model.events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e = e.select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return fold_status_files(e, f"{shared_folder(spark)}/status-{uuid.uuid4().hex}")


def entity_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type wins the entity's name."""
    e = model.events(spark, sf_dir)
    return first_writer(e.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities known from the first half of the log and those that the second half adds."""
    e = model.events(spark, sf_dir).select("user_id", "event_type", "event_id").withColumn("half", F.col("event_id") % 2)
    key = ["user_id", "event_type"]
    known = first_writer(e.where("half = 0"), key, ["event_id"])
    new = first_writer(e.where("half = 1"), key, ["event_id"]).join(known, key, "left_anti")
    return known.unionByName(new).select(*key, "event_id", (F.col("half") == 1).alias("added"))


def quintuplets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate and object literal read from the events' JSON."""
    e = model.events(spark, sf_dir)
    return e.select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object_literal"))


def user_orgs_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.user_orgs(model.memberships(spark, sf_dir), model.orgs(spark, sf_dir))
    return found.select("user_id", "org_id", "org_name", "role")


def namespace_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each member may do in ``default``: owners and admins all, others by their row, without one nothing."""
    m = model.memberships(spark, sf_dir).select("user_id", F.col("org_id").alias("tenant_id"), "role", F.lit("default").alias("namespace"))
    return access.with_permission(m, model.permissions(spark, sf_dir)).select("user_id", "tenant_id", "role", "may_read", "may_write")


def gated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes by the customers of orders to the organisation of the order's number: members with the right only."""
    o = model.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 25).cast("int").alias("tenant_id"))
    body = F.when(F.col("o_orderkey") % 5 == 0, "other")
    o = o.withColumn("namespace", access.request_namespace(F.lit(None).cast("string"), body))
    return access.gate(o, model.memberships(spark, sf_dir), model.permissions(spark, sf_dir), "write").select("o_orderkey", "user_id", "tenant_id", "namespace", "allowed")


def readable_claims_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces that each member may read, with hidden ones left out."""
    m = model.memberships(spark, sf_dir)
    ns = m.select("org_id").distinct().crossJoin(spark.createDataFrame([("default",), ("team",)], "name string"))  # two names for each of a nation's organisations
    return access.readable_namespaces(m, ns, model.permissions(spark, sf_dir)).withColumnRenamed("tenant_id", "org_id")


def owner_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations without exactly one owner."""
    return access.owner_violations(model.memberships(spark, sf_dir))


def upsert_profile_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, suppliers' names as new profiles of the same keys: only supplied, different fields change."""
    null = F.lit(None).cast("string")
    users = model.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"), null.alias("image"),
        F.lit(0).alias("created_at"), F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp").alias("updated_at"),
    )
    name = F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.col("s_name"))
    new = model.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("BUILDING")).alias("email"), null.alias("image"))
    synced = access.sync_profiles(users, new, datetime.datetime(2024, 6, 1))
    return synced.select("id", "name", "email", (F.col("updated_at") > F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp")).alias("changed"))


def provision_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with even keys exist; the others are provisioned. Every third gives no name, every fifth no mail."""
    c = model.table(spark, sf_dir, "customer")
    have = c.where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").cast("string").alias("id"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name"))
    mail = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.col("c_name"), F.lit("@mail.test")))
    new = c.select(F.col("c_custkey").cast("string").alias("id"), name.alias("name"), mail.alias("email"), F.lit(None).cast("string").alias("image"))
    made = access.provision(new, have, datetime.datetime(2024, 1, 1))
    owned = made["org_memberships"].join(made["orgs"].select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")
    return made["users"].join(owned.select(F.col("user_id").alias("id"), "org_name", "role"), "id").select("id", "name", "email", "org_name", "role")


def id_map_redirect_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's citation goes to the survivor of its content hash; the first 40 characters are cited."""
    c = model.hashed(model.claims(spark, sf_dir).select("id", "namespace", "content"))
    kept = c.groupBy("namespace", "content_hash").agg(F.min("id").alias("claim_id"))
    return c.join(kept, ["namespace", "content_hash"]).select(F.col("id").alias("episode_id"), "claim_id", utf16_slice("content", F.lit(0), F.lit(40)).alias("excerpt"))


def edge_endpoint_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose source must be a known claim; an unknown target stands for itself."""
    ids = model.claims(spark, sf_dir).where("status <> 'pending_review'").select("id")
    e = model.edges(spark, sf_dir).select("id", "source_claim_id", "target_claim_id", "relation")
    known = ids.select(F.col("id").alias("source_claim_id"))
    target = ids.select(F.col("id").alias("target_claim_id"), F.lit(True).alias("known"))
    return e.join(known, "source_claim_id", "left_semi").join(target, "target_claim_id", "left").select("id", "source_claim_id", "target_claim_id", "relation", F.coalesce("known", F.lit(False)).alias("known"))


def session_episode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of each session (our definition of a rollup)."""
    c = model.table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count("*").alias("episodes"), F.count_if(F.col("role") == "user").alias("by_user"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), F.max("turn").alias("last_turn")
    )


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as memory requests in JSON: parsed, given defaults, checked."""
    from ..sources.requests import parse_requests

    c = model.table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 4 == 3, F.lit("")).otherwise(F.col("text"))
    namespace = F.when(F.col("turn") % 2 == 0, F.col("role"))
    body = F.to_json(F.struct(text.alias("text"), namespace.alias("namespace"), F.col("conv_id").cast("string").alias("sessionId")))
    parsed = parse_requests(c.select("conv_id", "turn", body.alias("body")))
    return parsed.select("conv_id", "turn", "namespace", "session_id", F.col("problem").isNull().alias("valid"))


def truthy_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replacement texts: none for null or empty ones, trimmed and hashed otherwise."""
    c = model.table(spark, sf_dir, "conversations").where(present("text"))
    return c.select("conv_id", "turn", content_hash("text").alias("content_hash"), F.length(js_trim("text")).cast("long").alias("chars"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each table after deleting the superseded claims."""
    c = model.claims(spark, sf_dir).select("id", "status")
    e = model.edges(spark, sf_dir).select("id", "source_claim_id", "target_claim_id")
    ev = model.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("claim_id"), F.lit(None).cast("bigint").alias("episode_id"))
    left = status.cascade_delete({"memory_claims": c, "memory_relationships": e, "evidence": ev}, "memory_claims", c.where("status = 'superseded'"))
    out = None
    for name, df in left.items():
        n = df.select(F.lit(name).alias("name"), "id").groupBy("name").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = n if out is None else out.unionByName(n)
    return out


def evidence_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of each text by offsets."""
    d = model.table(spark, sf_dir, "documents")
    n = F.length("text")
    return d.select("doc_id", F.md5(utf16_slice("text", (n / 3).cast("int"), (n * 2 / 3).cast("int")).cast("binary")).alias("excerpt_md5"))


def structured_attributes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.events(spark, sf_dir).select("event_id", *structured_attributes("ts"))


def weekend_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of weekends by type and quarter."""
    e = model.events(spark, sf_dir).select("event_type", *structured_attributes("ts"))
    return e.where("is_weekend").groupBy("event_type", "year", "quarter").agg(F.count("*").alias("n"))


def bitemporal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in force in the middle of the log."""
    t = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    return graph.as_of(model.edges(spark, sf_dir), t, t).select("id", "relation", "valid_at", "invalid_at")


def edge_invalid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_closing_time(model.events(spark, sf_dir), ["user_id", "event_type"]).select("event_id", "invalid_at")


def edge_close_on_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of superseded claims that end with them."""
    gone = model.claims(spark, sf_dir).where("status = 'superseded'").select("id")
    closed = graph.close_edges(model.edges(spark, sf_dir), gone, F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")))
    return closed.select("id", "relation", F.col("tx_expired_at").isNotNull().alias("closed"))


def lineage_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each claim of the log goes back to over UPDATES and DERIVES."""
    e = model.edges(spark, sf_dir)
    return graph.lineage(e, e.select("id")).select("root", "id", F.col("depth").cast("long").alias("depth"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, text and recency ranks of the active claims, fused."""
    c = status.active(model.claims(spark, sf_dir))
    d = retrieval.with_distance(c.drop("content").join(F.broadcast(_query_vector(spark, sf_dir))), model.vectors(spark, sf_dir), F.col("query"), 6)
    by_vector = retrieval.ranked(d, F.col("distance").asc(), F.col("recorded_at").desc(), F.col("id").asc())
    text = retrieval.text_scores(c, "the and that license").withColumn("text_score", F.round("text_score", 6))
    by_text = retrieval.ranked(text, F.col("text_score").desc(), F.col("id").asc())
    by_time = retrieval.ranked(c, F.col("recorded_at").desc(), F.col("id").asc())
    return retrieval.fused(by_vector, by_text, by_time).select("id", F.col("rank").cast("long").alias("rank"))


def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extraction records in JSON: parsed, validated item by item, bad records in quarantine."""
    e = model.events(spark, sf_dir)
    claim = F.struct(F.lit("c0").alias("tempId"), F.col("event_type").alias("content"), F.lit("fact").alias("kind"), (F.col("value") / 100).alias("confidence"), F.array(F.lit("x")).alias("categories"))
    edge = F.struct(F.lit("c0").alias("sourceTempId"), F.lit("c1").alias("targetIdOrTempId"), F.when(F.col("event_id") % 10 == 0, "BREAKS").otherwise("EXTENDS").alias("relation"), F.lit("r").alias("reason"))
    none = F.from_json(F.lit("[]"), "array<struct<x: string>>")
    record = F.to_json(F.struct(F.array(claim).alias("claims"), F.array(edge).alias("memoryRelationships"), none.alias("entityRelationships"), none.alias("mutations"), none.alias("evidence")))
    items = parse_responses(e.select(F.col("event_id").cast("string").alias("episode_id"), F.when(F.col("event_id") % 17 == 0, "not json").otherwise(record).alias("response")))
    out = items["quarantine"].select("episode_id", "item", "problem")
    for name in ITEMS.values():
        out = out.unionByName(items[name].select("episode_id", F.lit(name).alias("item"), F.lit("ok").alias("problem")))
    return out.select(F.col("episode_id").cast("long").alias("event_id"), "item", "problem")


def _resolved(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every event as an episode of its own scope with one old claim (o and its number), two extracted ones (a, b), mutations of the
    old one or of one that does not exist, and citations, edges and quintuplets of old, extracted and unknown claims."""
    e = model.events(spark, sf_dir).select("event_id", "event_type")
    n, key = F.col("event_id"), F.col("event_id").cast("string")
    scope = [F.lit("t").alias("tenant_id"), F.lit("n").alias("namespace"), F.concat(F.lit("u"), key).alias("user_id")]
    named = lambda letter: F.concat(F.lit(letter), key)
    old, a, b = F.concat(F.lit("old "), "event_type"), F.concat(F.lit("new "), key), F.concat(F.lit("text of b "), key)
    first = F.when(n % 3 == 0, old).otherwise(a)
    episodes = e.select(key.alias("episode_id"), *scope, n.alias("seq"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit("a").alias("temp_id"), named("a").alias("id"), first.alias("content")), F.struct(F.lit(1).alias("idx"), F.lit("b").alias("temp_id"), named("b").alias("id"), b.alias("content"))))
    pending = e.select(key.alias("episode_id"), *scope, n.alias("seq"), both.alias("c")).select("episode_id", "tenant_id", "namespace", "user_id", "seq", "c.*").withColumn("content_hash", content_hash("content"))
    claims = e.select(named("o").alias("id"), *scope, content_hash(old).alias("content_hash"), F.lit("active").alias("status"))
    text = F.when(n % 4 == 0, F.concat(F.lit(" Replaced "), key)).when(n % 4 == 2, F.concat(F.lit("TEXT of b "), key))
    action = F.when(n % 4 == 3, "noop").when(n % 4 == 1, "delete").otherwise("update")

    def items(*rows: tuple[Column, ...], names: str) -> DataFrame:
        each = [F.struct(F.lit(i).alias("idx"), *[c.alias(m) for c, m in zip(r, names.split(), strict=True)]) for i, r in enumerate(rows)]
        return e.select(key.alias("episode_id"), F.explode(F.array(*each)).alias("x")).select("episode_id", "x.*")

    lit, why = F.lit, F.lit("why")
    lost = F.when(n % 5 == 0, "nowhere").otherwise(named("o"))
    got = {
        "mutations": items((named("o"), action, text, why), (lost, F.when(n % 5 == 0, "delete").otherwise("noop"), lit(None).cast("string"), why), names="targetClaimId action replacementContent reason"),
        "evidence": items((lit("a"), lit(0), lit(3), lit("a")), (named("o"), lit(1), lit(2), lit("old")), (lit("zz"), lit(0), lit(1), lit("lost")), names="claimTempId startOffset endOffset excerpt"),
        "edges": items((lit("b"), lit("a"), lit("EXTENDS"), why), (named("o"), lit("b"), lit("SUPPORTS"), why), (lit("a"), lit("elsewhere"), lit("MENTIONS"), why), (lit("zz"), lit("a"), lit("DERIVES"), why), names="sourceTempId targetIdOrTempId relation reason"),
        "quintuplets": items((F.col("event_type"), lit("is"), lit("x"), lit("s"), why, lit("a")), (F.col("event_type"), lit("was"), lit("y"), lit("s"), why, named("o")), (lit("ghost"), lit("was"), lit("z"), lit("s"), why, lit("zz")), names="subject predicate object scope rationale sourceTempId"),
    }
    none = spark.createDataFrame([], "id string, tenant_id string, namespace string, canonical_name string")
    seen = e.select(key.alias("episode_id"), named("o").alias("id"))
    return resolve(got, pending, episodes, claims, seen, none, datetime.datetime(2024, 1, 1))


def _label(name: str) -> Column:
    """Ids of given claims as they stand, those that were made as ``made``."""
    return F.when(F.col(name).rlike("^([abo][0-9]+|elsewhere)$"), F.col(name)).otherwise("made").alias(name)


def resolve_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mutations and the extracted claims of every event come to: changed status, replacements, duplicates, refusals."""
    r = _resolved(spark, sf_dir)
    none = F.lit(None).cast("string")
    events = r["claim_status_events"].select(F.col("status").alias("what"), F.col("claim_id").alias("id"), none.alias("other"))
    made = r["memory_claims"].select(F.lit("replacement").alias("what"), F.col("content").alias("id"), none.alias("other"))
    dropped = r["removed"].select(F.lit("duplicate").alias("what"), "id", F.col("survivor").alias("other"))
    refused = r["quarantine"].select(F.lit("refused").alias("what"), F.col("episode_id").alias("id"), F.col("problem").alias("other"))
    return events.unionByName(made).unionByName(dropped).unionByName(refused)


def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of extracted and old claims, and those from replacements to what they replace."""
    r = _resolved(spark, sf_dir)["memory_relationships"]
    return r.select(_label("source_claim_id"), _label("target_claim_id"), "relation")


def resolve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of extracted claims, which follow duplicates, and of old ones."""
    return _resolved(spark, sf_dir)["evidence"].select(F.col("episode_id").cast("long").alias("event_id"), "claim_id", "excerpt", "start_offset", "end_offset")


def resolve_quintuplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quintuplets with their subject's name and the claim that they come from."""
    r = _resolved(spark, sf_dir)
    names = r["entities"].select(F.col("id").alias("subject_entity_id"), "canonical_name")
    return r["entity_relationships"].join(names, "subject_entity_id").select("canonical_name", "predicate", "object_literal", "source_claim_id")


def active_hash_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest active claim of the same scope and content hash, for each claim; -1 for none."""
    c = model.hashed(model.claims(spark, sf_dir))
    probes = c.select(F.col("id").alias("probe_id"), "tenant_id", "namespace", "user_id", "content_hash")
    return retrieval.active_by_hash(c, probes).select("probe_id", F.coalesce("survivor", F.lit(-1)).alias("survivor"))


def prompt_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each claim with a vector as a prompt's JSON list: how many there are, and the ids in order."""
    found = candidate_topk_per_episode(spark, sf_dir)
    c = model.claims(spark, sf_dir).select("id", "kind", F.lit("").alias("content"), "recorded_at")
    v = model.vectors(spark, sf_dir).select(F.col("entity_id").alias("episode_id"), F.lit("").alias("raw_text"))
    p = retrieval.prompts(v, found.join(c, "id"))
    parsed = F.from_json("candidates", "array<struct<id: bigint>>")
    return p.select("episode_id", F.size(parsed).cast("long").alias("n"), F.array_join(F.transform(parsed, lambda x: x["id"].cast("string")), ",").alias("ids"))


def tenant_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that would cross namespaces."""
    c = model.claims(spark, sf_dir).select("id", "tenant_id", "namespace")
    return graph.crossing_edges(model.edges(spark, sf_dir).select("id", "source_claim_id", "target_claim_id"), c)


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON holds a value, by the containment filter."""
    e = model.events(spark, sf_dir)
    scope = [F.lit(TENANT).alias("tenant_id"), F.lit(NAMESPACE).alias("namespace"), F.lit(USER).alias("scope_user"), F.lit("active").alias("status")]
    c = e.select("event_id", F.col("user_id").alias("own_user"), F.col("props").alias("metadata"), *scope).withColumnRenamed("scope_user", "user_id")
    return retrieval.in_scope(c, TENANT, NAMESPACE, USER, metadata={"k": 7}).select("event_id", F.col("own_user").alias("user_id"))


def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and labels whose claim does not exist, and keys that repeat."""
    c = model.claims(spark, sf_dir).select("id")
    v = model.vectors(spark, sf_dir).select("entity_id")
    orphans = status.reference_violations(v, "entity_id", c).select(F.lit("vectors").alias("what"), F.col("entity_id").alias("id"))
    twice = status.unique_violations(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "memory_claims")
    return orphans.unionByName(twice.select(F.lit("repeated").alias("what"), "id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        candidate_topk, candidate_topk_scoped, candidate_topk_per_episode, vector_neighbours, missing_vector_rank, content_hash_dedupe, dedupe_decisions,
        active_visible_claims, status_counts, latest_status_fold, streaming_status_fold, entity_first_writer, entity_upsert, quintuplets_from_events, user_orgs_inner_join,
        namespace_acl, gated_requests, readable_claims_by_member, owner_invariant, upsert_profile_sync, provision_users, id_map_redirect_evidence,
        edge_endpoint_coalesce, session_episode_rollup, request_validation, truthy_replacements, cascade_delete, evidence_slice, weekend_filter,
        bitemporal_asof, edge_invalid_at, edge_close_on_supersede, lineage_recursive, hybrid_rrf, extraction_records, prompt_rendering, tenant_isolation,
        resolve_mutations, resolve_edges, resolve_evidence, resolve_quintuplets, active_hash_probe,
        metadata_filter, reference_check,
    ]
    return {f.__name__: f for f in found} | {"structured_attributes": structured_attributes_query}


