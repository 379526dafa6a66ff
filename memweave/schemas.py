"""Table and record schemas. Ids are strings everywhere; an organisation's id is its tenant id."""

from __future__ import annotations

from pyspark.sql.types import StructType


#: Stored tables, as DDL, which needs no session to be written down.
TABLES: dict[str, str] = {
    "users": ("id string not null, name string, email string, image string, created_at timestamp, updated_at timestamp"),
    "orgs": ("id string not null, name string, created_at timestamp"),
    "org_memberships": ("org_id string not null, user_id string not null, role string, joined_at timestamp"),
    "namespaces": ("org_id string not null, name string not null, created_at timestamp"),
    "namespace_permissions": ("org_id string not null, namespace string not null, user_id string not null, can_read boolean, can_write boolean"),
    "episodes": ("id string not null, raw_text string, user_id string, session_id string, created_at timestamp"),
    "memory_claims": ("id string not null, tenant_id string, namespace string, user_id string, entity_key string, session_id string, content string, kind string, "
        "status string, confidence float, categories array<string>, content_hash string, metadata string, occurred_at timestamp, recorded_at timestamp, updated_at timestamp"),
    "claim_status_events": ("claim_id string not null, status string, seq bigint, at timestamp"),
    "memory_relationships": ("id string not null, source_claim_id string, target_claim_id string, relation string, confidence float, reason string, tenant_id string, namespace string, "
        "valid_at timestamp, invalid_at timestamp, tx_created_at timestamp, tx_expired_at timestamp"),
    "evidence": ("id string not null, claim_id string, episode_id string, start_offset int, end_offset int, excerpt string, confidence float, created_at timestamp"),
    "entities": ("id string not null, canonical_name string, type string, aliases array<string>, user_id string, tenant_id string, namespace string, first_seen_at timestamp, last_seen_at timestamp"),
    "entity_relationships": ("id string not null, subject_entity_id string, predicate string, object_entity_id string, object_literal string, scope string, rationale string, source_claim_id string, "
        "confidence float, valid_at timestamp, invalid_at timestamp, tx_created_at timestamp, tx_expired_at timestamp"),
    "vectors": ("id string not null, entity_type string, entity_id string, embedding array<float>"),
    "quarantine": ("episode_id string, item string, idx int, problem string, at timestamp"),
}

#: Uniqueness that the tables promise, and references that deletes cascade over: (child, column, parent).
KEYS: dict[str, list[str]] = {
    "users": ["id"], "orgs": ["id"], "org_memberships": ["org_id", "user_id"], "namespaces": ["org_id", "name"],
    "namespace_permissions": ["org_id", "namespace", "user_id"], "episodes": ["id"], "memory_claims": ["id"], "memory_relationships": ["id"],
    "evidence": ["id"], "entities": ["tenant_id", "namespace", "canonical_name"], "entity_relationships": ["id"], "vectors": ["id"],
}
REFERENCES: list[tuple[str, str, str]] = [
    ("org_memberships", "org_id", "orgs"), ("org_memberships", "user_id", "users"), ("namespaces", "org_id", "orgs"),
    ("namespace_permissions", "org_id", "orgs"), ("namespace_permissions", "user_id", "users"),
    ("memory_relationships", "source_claim_id", "memory_claims"), ("memory_relationships", "target_claim_id", "memory_claims"),
    ("evidence", "claim_id", "memory_claims"), ("evidence", "episode_id", "episodes"),
    ("entity_relationships", "subject_entity_id", "entities"), ("entity_relationships", "object_entity_id", "entities"),
    ("entity_relationships", "source_claim_id", "memory_claims"),
]

#: Fixed values of the wire records.
STATUSES = ("pending_review", "active", "superseded", "deleted")
RELATIONS = ("UPDATES", "EXTENDS", "SUPPORTS", "CONTRADICTS", "DERIVES", "MENTIONS")
ACTIONS = ("update", "delete", "noop")
ROLES = ("owner", "admin", "member")

#: Wire records.
CREATE_MEMORY = "text string, namespace string, entityKey string, sessionId string"
JOB = "episodeId string, tenantId string, namespace string, userId string, entityKey string, sessionId string, rawText string"
EXTRACTION = ("claims array<struct<tempId: string, content: string, kind: string, confidence: double, categories: array<string>>>, "
    "memoryRelationships array<struct<sourceTempId: string, targetIdOrTempId: string, relation: string, reason: string>>, "
    "entityRelationships array<struct<subject: string, predicate: string, object: string, scope: string, rationale: string, sourceTempId: string>>, "
    "mutations array<struct<targetClaimId: string, action: string, replacementContent: string, reason: string>>, "
    "evidence array<struct<claimTempId: string, startOffset: int, endOffset: int, excerpt: string>>")


def struct(table: str) -> StructType:
    """A table's schema; needs a session."""
    return StructType.fromDDL(TABLES[table])
