"""DuckDB SQL for the memory model's queries, over the benchmark tables."""

from __future__ import annotations

from ..functions import JS_SPACE

_HASH = f"sha256(lower(trim({{0}}, '{JS_SPACE}')))"
_STATUS = "CASE WHEN l.quality IS NULL THEN 'pending_review' WHEN l.quality = 1 AND l.toxic = 0 THEN 'active' ELSE 'superseded' END"
_CLAIMS = f"""claims AS (
  SELECT d.doc_id AS id, d.source AS tenant_id, d.lang AS namespace, d.doc_id % 2 AS user_id, d.text AS content, 'fact' AS kind, {_STATUS} AS status, d.doc_id AS recorded_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_HASHED = f"{_CLAIMS}, hashed AS (SELECT *, {_HASH.format('content')} AS content_hash FROM claims)"
_QUERY = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DISTANCE = f"coalesce(round(list_cosine_distance(e.embedding::DOUBLE[], {_QUERY}), 6), 1.0)"
_MEMBERS = """members AS (
  SELECT c_custkey AS user_id, c_nationkey AS org_id, CASE WHEN c_custkey % 25 = 0 THEN 'owner' WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'member' END AS role FROM customer),
permissions AS (SELECT org_id, 'default' AS namespace, user_id, user_id % 2 = 0 AS can_read, user_id % 4 = 0 AS can_write FROM members WHERE user_id % 3 = 0)"""
_EDGES = """edges AS (
  SELECT event_id AS id, event_id AS source_claim_id, event_id // 2 AS target_claim_id,
    CASE event_type WHEN 'signup' THEN 'DERIVES' WHEN 'purchase' THEN 'UPDATES' WHEN 'view' THEN 'SUPPORTS' WHEN 'click' THEN 'CONTRADICTS' ELSE 'MENTIONS' END AS relation,
    ts AS valid_at, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at, ts AS tx_created_at FROM events)"""
_SCOPED = """per AS (
  SELECT q.id AS episode_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY coalesce(round(list_cosine_distance(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), 1.0), c.recorded_at DESC, c.id) AS rank
  FROM claims q JOIN embeddings e ON e.vec_id = q.id
  JOIN claims c ON c.tenant_id = q.tenant_id AND c.namespace = q.namespace AND c.user_id = q.user_id AND c.status = 'active'
  LEFT JOIN embeddings v ON v.vec_id = c.id)"""

#: Of each event the mutation it has (0 a new text, 1 delete, 2 the text of b, 3 none) and where claim a ends up.
_FATE = """fate AS (SELECT event_id, event_type, event_id % 4 AS m, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 3 THEN 'o' ELSE 'a' END || event_id AS a FROM events)"""

SQL: dict[str, str] = {
    "candidate_topk": f"""WITH {_CLAIMS} SELECT c.id, c.kind, c.recorded_at, row_number() OVER (ORDER BY {_DISTANCE}, c.recorded_at DESC, c.id)::INTEGER AS rank
        FROM claims c LEFT JOIN embeddings e ON e.vec_id = c.id WHERE c.namespace = 'en' AND c.status = 'active' ORDER BY rank LIMIT 10""",
    "candidate_topk_scoped": f"""WITH {_CLAIMS} SELECT c.id, c.kind, c.recorded_at, trim(c.content, '{JS_SPACE}') AS content FROM claims c LEFT JOIN embeddings e ON e.vec_id = c.id
        WHERE c.tenant_id = 'src1' AND c.namespace = 'en' AND c.user_id = 1 AND c.status = 'active' ORDER BY {_DISTANCE}, c.recorded_at DESC, c.id LIMIT 10""",
    "candidate_topk_per_episode": f"WITH {_CLAIMS}, {_SCOPED} SELECT episode_id, id, rank FROM per WHERE rank <= 10",
    "vector_neighbours": """SELECT query_id, id, rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), v.vec_id) AS rank
        FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
    "missing_vector_rank": f"""WITH {_CLAIMS}, d AS (SELECT c.namespace, {_DISTANCE} AS distance FROM claims c LEFT JOIN embeddings e ON e.vec_id = c.id WHERE c.status = 'active')
        SELECT namespace, count(*) FILTER (distance < 1) AS nearer, count(*) FILTER (distance = 1) AS unknown, count(*) FILTER (distance > 1) AS farther FROM d GROUP BY namespace""",
    "content_hash_dedupe": f"WITH {_HASHED} SELECT namespace, content_hash, min(id) AS survivor, count(*) AS n FROM hashed GROUP BY namespace, content_hash",
    "dedupe_decisions": f"""WITH {_HASHED}, a AS (SELECT tenant_id, namespace, user_id, content_hash, min(id) AS survivor FROM hashed WHERE status = 'active' GROUP BY ALL),
        p AS (SELECT h.id, coalesce(a.survivor, first_value(h.id) OVER (PARTITION BY h.tenant_id, h.namespace, h.user_id, h.content_hash ORDER BY h.id)) AS kept
        FROM hashed h LEFT JOIN a USING (tenant_id, namespace, user_id, content_hash) WHERE h.status = 'pending_review')
        SELECT id, CASE WHEN id = kept THEN 'activate' ELSE 'duplicate' END AS decision, kept FROM p""",
    "active_visible_claims": f"WITH {_CLAIMS} SELECT id, tenant_id, namespace, user_id, length(content) AS chars FROM claims WHERE status = 'active'",
    "status_counts": f"WITH {_CLAIMS} SELECT tenant_id, namespace, status, count(*) AS n FROM claims GROUP BY ALL",
    "latest_status_fold": "SELECT user_id AS claim_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id",
    "streaming_status_fold": "SELECT user_id AS claim_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id",
    "entity_first_writer": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
    "entity_upsert": """WITH h AS (SELECT user_id, event_type, event_id % 2 AS half, min(event_id) AS event_id FROM events GROUP BY ALL)
        SELECT user_id, event_type, event_id, half = 1 AS added FROM h WHERE half = 0 OR NOT EXISTS (
          SELECT 1 FROM h k WHERE k.half = 0 AND k.user_id = h.user_id AND k.event_type = h.event_type)""",
    "quintuplets_from_events": "SELECT event_id, user_id AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object_literal FROM events",
    "user_orgs_inner_join": f"WITH {_MEMBERS} SELECT m.user_id, m.org_id, n.n_name AS org_name, m.role FROM members m JOIN nation n ON m.org_id = n.n_nationkey",
    "namespace_acl": f"""WITH {_MEMBERS} SELECT m.user_id, m.org_id AS tenant_id, m.role, m.role IN ('owner', 'admin') OR coalesce(p.can_read, false) AS may_read,
        m.role IN ('owner', 'admin') OR coalesce(p.can_write, false) AS may_write FROM members m LEFT JOIN permissions p ON p.org_id = m.org_id AND p.user_id = m.user_id AND p.namespace = 'default'""",
    "gated_requests": f"""WITH {_MEMBERS}, r AS (SELECT o_orderkey, o_custkey AS user_id, (o_orderkey % 25)::INTEGER AS tenant_id, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'default' END AS namespace FROM orders)
        SELECT r.*, m.user_id IS NOT NULL AND (coalesce(m.role IN ('owner', 'admin'), false) OR coalesce(p.can_write, false)) AS allowed FROM r
        LEFT JOIN members m ON m.user_id = r.user_id AND m.org_id = r.tenant_id LEFT JOIN permissions p ON p.org_id = r.tenant_id AND p.user_id = r.user_id AND p.namespace = r.namespace""",
    "readable_claims_by_member": f"""WITH {_MEMBERS} SELECT m.user_id, m.org_id, n.name AS namespace FROM members m, (VALUES ('default'), ('team')) n(name)
        LEFT JOIN permissions p ON p.org_id = m.org_id AND p.user_id = m.user_id AND p.namespace = n.name WHERE m.role IN ('owner', 'admin') OR coalesce(p.can_read, false)""",
    "owner_invariant": f"WITH {_MEMBERS} SELECT org_id, count(*) FILTER (role = 'owner') AS owners FROM members GROUP BY org_id HAVING owners <> 1",
    "upsert_profile_sync": """WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' END AS email FROM supplier)
        SELECT c_custkey AS id, coalesce(n.name, c_name) AS name, coalesce(n.email, c_mktsegment) AS email,
          coalesce(n.name <> c_name, false) OR coalesce(n.email <> c_mktsegment, false) AS changed FROM customer LEFT JOIN n ON n.id = c_custkey""",
    "provision_users": """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'New User' ELSE c_name END AS name,
        CASE WHEN c_custkey % 5 = 0 THEN c_custkey || '@clerk.local' ELSE c_name || '@mail.test' END AS email,
        CASE WHEN c_custkey % 3 = 0 THEN 'My Org' ELSE c_name || '''s Org' END AS org_name, 'owner' AS role FROM customer WHERE c_custkey % 2 <> 0""",
    "id_map_redirect_evidence": f"""WITH {_HASHED} SELECT id AS episode_id, min(id) OVER (PARTITION BY namespace, content_hash) AS claim_id, substring(content, 1, 40) AS excerpt FROM hashed""",
    "edge_endpoint_coalesce": f"""WITH {_CLAIMS}, {_EDGES}, ids AS (SELECT id FROM claims WHERE status <> 'pending_review')
        SELECT id, source_claim_id, target_claim_id, relation, target_claim_id IN (SELECT id FROM ids) AS known FROM edges WHERE source_claim_id IN (SELECT id FROM ids)""",
    "session_episode_rollup": """SELECT conv_id AS session_id, count(*) AS episodes, count(*) FILTER (role = 'user') AS by_user, sum(coalesce(length(text), 0))::BIGINT AS chars, max(turn) AS last_turn
        FROM conversations GROUP BY conv_id""",
    "request_validation": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(role, 'default') ELSE 'default' END AS namespace, conv_id::VARCHAR AS session_id,
        turn % 4 <> 3 AND coalesce(length(text), 0) > 0 AS valid FROM conversations""",
    "truthy_replacements": f"""SELECT conv_id, turn, {_HASH.format('text')} AS content_hash, length(trim(text, '{JS_SPACE}')) AS chars FROM conversations WHERE length(text) > 0""",
    "cascade_delete": f"""WITH {_CLAIMS}, {_EDGES}, gone AS (SELECT id FROM claims WHERE status = 'superseded'),
        t AS (SELECT 'memory_claims' AS name, id FROM claims WHERE id NOT IN (FROM gone)
          UNION ALL SELECT 'memory_relationships', id FROM edges WHERE source_claim_id NOT IN (FROM gone) AND target_claim_id NOT IN (FROM gone)
          UNION ALL SELECT 'evidence', event_id FROM events WHERE user_id NOT IN (FROM gone))
        SELECT name, count(*) AS n, sum(id)::BIGINT AS ids FROM t GROUP BY name""",
    "evidence_slice": """SELECT doc_id, md5(substring(text, floor(length(text) / 3)::INTEGER + 1, floor(length(text) * 2 / 3)::INTEGER - floor(length(text) / 3)::INTEGER)) AS excerpt_md5 FROM documents""",
    "structured_attributes": """SELECT event_id, day(ts)::INTEGER AS day, month(ts)::INTEGER AS month, year(ts)::INTEGER AS year, quarter(ts)::INTEGER AS quarter,
        dayofweek(ts)::INTEGER AS day_of_week, dayofweek(ts) IN (0, 6) AS is_weekend FROM events""",
    "weekend_filter": """SELECT event_type, year(ts)::INTEGER AS year, quarter(ts)::INTEGER AS quarter, count(*) AS n FROM events WHERE dayofweek(ts) IN (0, 6) GROUP BY ALL""",
    "bitemporal_asof": f"""WITH {_EDGES} SELECT id, relation, valid_at, invalid_at FROM edges
        WHERE valid_at <= TIMESTAMP '2024-01-15 12:00:00' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-15 12:00:00') AND tx_created_at <= TIMESTAMP '2024-01-15 12:00:00'""",
    "edge_invalid_at": "SELECT event_id, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at FROM events",
    "edge_close_on_supersede": f"""WITH {_CLAIMS}, {_EDGES}, gone AS (SELECT id FROM claims WHERE status = 'superseded')
        SELECT id, relation, relation IN ('SUPPORTS', 'CONTRADICTS') AND (source_claim_id IN (FROM gone) OR target_claim_id IN (FROM gone)) AS closed FROM edges""",
    "lineage_recursive": f"""WITH RECURSIVE {_EDGES}, walk AS (
          SELECT id AS root, id, 0 AS depth FROM edges
          UNION SELECT w.root, e.target_claim_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_claim_id = w.id AND e.relation IN ('UPDATES', 'DERIVES') AND e.target_claim_id <> e.source_claim_id)
        SELECT root, id, min(depth)::BIGINT AS depth FROM walk GROUP BY root, id""",
    "hybrid_rrf": rf"""WITH {_CLAIMS}, act AS (SELECT * FROM claims WHERE status = 'active'),
        v AS (SELECT c.id, row_number() OVER (ORDER BY {_DISTANCE}, c.recorded_at DESC, c.id) AS rank FROM act c LEFT JOIN embeddings e ON e.vec_id = c.id),
        words AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM act),
        s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
        hits AS (SELECT id, len(w) AS length, t.x AS x, count(*) AS tf FROM words, unnest(w) t(x) WHERE t.x IN ('the', 'and', 'that', 'license') GROUP BY ALL),
        df AS (SELECT x, count(*) AS df FROM hits GROUP BY x),
        b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM hits JOIN df USING (x), s GROUP BY id),
        t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b),
        r AS (SELECT id, row_number() OVER (ORDER BY recorded_at DESC, id) AS rank FROM act),
        every AS (SELECT * FROM v UNION ALL SELECT * FROM t UNION ALL SELECT * FROM r),
        f AS (SELECT id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM every GROUP BY id)
        SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY rank LIMIT 10""",
    "extraction_records": """SELECT event_id, 'record' AS item, 'not a record' AS problem FROM events WHERE event_id % 17 = 0
        UNION ALL SELECT event_id, unnest(['claims', 'edges']), 'ok' FROM events WHERE event_id % 17 <> 0 AND event_id % 10 <> 0 AND value / 100 BETWEEN 0 AND 1
        UNION ALL SELECT event_id, 'edges', 'unknown relation' FROM events WHERE event_id % 17 <> 0 AND event_id % 10 = 0
        UNION ALL SELECT event_id, 'claims', 'confidence is not in 0..1' FROM events WHERE event_id % 17 <> 0 AND NOT (value / 100 BETWEEN 0 AND 1)""",
    "prompt_rendering": f"""WITH {_CLAIMS}, {_SCOPED} SELECT v.vec_id AS episode_id, count(p.id) AS n, coalesce(string_agg(p.id, ',' ORDER BY p.rank), '') AS ids
        FROM embeddings v LEFT JOIN per p ON p.episode_id = v.vec_id AND p.rank <= 10 GROUP BY v.vec_id""",
    "tenant_isolation": f"""WITH {_CLAIMS}, {_EDGES} SELECT e.id, e.source_claim_id, e.target_claim_id FROM edges e JOIN claims a ON a.id = e.source_claim_id JOIN claims b ON b.id = e.target_claim_id
        WHERE (a.tenant_id, a.namespace) <> (b.tenant_id, b.namespace)""",
    "metadata_filter": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "resolve_mutations": f"""WITH {_FATE}
        SELECT 'superseded' AS what, 'o' || event_id AS id, NULL::VARCHAR AS other FROM fate WHERE m <> 3
        UNION ALL SELECT 'active', a, NULL FROM fate WHERE a[1] = 'a'
        UNION ALL SELECT 'active', 'b' || event_id, NULL FROM fate
        UNION ALL SELECT 'replacement', 'Replaced ' || event_id, NULL FROM fate WHERE m = 0
        UNION ALL SELECT 'duplicate', 'a' || event_id, a FROM fate WHERE a[1] = 'o'
        UNION ALL SELECT 'refused', event_id::VARCHAR, 'no such claim to change' FROM fate WHERE event_id % 5 = 0""",
    "resolve_edges": f"""WITH {_FATE}
        SELECT 'b' || event_id AS source_claim_id, a AS target_claim_id, 'EXTENDS' AS relation FROM fate
        UNION ALL SELECT 'o' || event_id, 'b' || event_id, 'SUPPORTS' FROM fate
        UNION ALL SELECT a, 'elsewhere', 'MENTIONS' FROM fate
        UNION ALL SELECT CASE m WHEN 0 THEN 'made' ELSE 'b' || event_id END, 'o' || event_id, 'UPDATES' FROM fate WHERE m IN (0, 2)""",
    "resolve_evidence": f"""WITH {_FATE} SELECT event_id, a AS claim_id, 'a' AS excerpt, 0 AS start_offset, 3 AS end_offset FROM fate
        UNION ALL SELECT event_id, 'o' || event_id, 'old', 1, 2 FROM fate""",
    "resolve_quintuplets": f"""WITH {_FATE} SELECT event_type AS canonical_name, 'is' AS predicate, 'x' AS object_literal, a AS source_claim_id FROM fate
        UNION ALL SELECT event_type, 'was', 'y', 'o' || event_id FROM fate""",
    "active_hash_probe": f"""WITH {_HASHED}, s AS (SELECT tenant_id, namespace, user_id, content_hash, min(id) AS survivor FROM hashed WHERE status = 'active' GROUP BY ALL)
        SELECT h.id AS probe_id, coalesce(s.survivor, -1) AS survivor FROM hashed h LEFT JOIN s USING (tenant_id, namespace, user_id, content_hash)""",
    "reference_check": """SELECT 'vectors' AS what, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'repeated', doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
