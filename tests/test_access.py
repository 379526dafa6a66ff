"""Membership, permissions, provisioning and requests."""

import datetime

import pytest

from memweave.operators import access
from memweave.sources import requests

NOW = datetime.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def world(spark):
    m = spark.createDataFrame([("o", "own", "owner"), ("o", "mem", "member"), ("o", "bare", "member"), ("p", "adm", "admin")], "org_id string, user_id string, role string")
    p = spark.createDataFrame([("o", "default", "mem", True, False)], "org_id string, namespace string, user_id string, can_read boolean, can_write boolean")
    return m, p


def test_owner_bypasses_member_needs_a_grant(spark, world):
    m, p = world
    asked = [("own", "o"), ("mem", "o"), ("bare", "o"), ("adm", "o"), ("mem", None)]
    r = spark.createDataFrame([(u, t, "default") for u, t in asked], "user_id string, tenant_id string, namespace string")
    for what, want in (("read", {"own", "mem"}), ("write", {"own"})):
        assert {x.user_id for x in access.gate(r, m, p, what).where("allowed").collect()} == want
    assert {(x.user_id, x.role) for x in access.verified_membership(r, m).collect()} == {("own", "owner"), ("mem", "member"), ("bare", "member")}


def test_hidden_namespaces_and_owner_invariant(spark, world):
    m, p = world
    ns = spark.createDataFrame([("o", "default"), ("o", "secret"), ("p", "default")], "org_id string, name string")
    got = {tuple(r) for r in access.readable_namespaces(m, ns, p).collect()}
    assert got == {("own", "o", "default"), ("own", "o", "secret"), ("mem", "o", "default"), ("adm", "p", "default")}
    assert [(r.org_id, r.owners) for r in access.owner_violations(m).collect()] == [("p", 0)]


def test_provision_only_new_users(spark):
    ids = spark.createDataFrame([("a", None, "Domain Test User", None), ("b", "b@x", "", "pic"), ("a", None, "Domain Test User", None), ("old", None, None, None)], "id string, email string, name string, image string")
    out = access.provision(ids, spark.createDataFrame([("old",)], "id string"), NOW)
    assert {(r.id, r.name, r.email) for r in out["users"].collect()} == {("a", "Domain Test User", "a@clerk.local"), ("b", "New User", "b@x")}
    assert {r.name for r in out["orgs"].collect()} == {"Domain Test User's Org", "My Org"}
    assert {(r.user_id, r.role) for r in out["org_memberships"].collect()} == {("a", "owner"), ("b", "owner")}
    assert {(r.namespace, r.can_read, r.can_write) for r in out["namespace_permissions"].collect()} == {("default", True, True)}


def test_profile_sync_changes_only_what_differs(spark):
    old = datetime.datetime(2020, 1, 1)
    users = spark.createDataFrame([("a", "A", "a@x", None, old, old), ("b", "B", "b@x", "i", old, old)], "id string, name string, email string, image string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("a", "A2", None, "pic"), ("b", "B", "", "i")], "id string, name string, email string, image string")
    got = {r.id: (r.name, r.email, r.image, r.updated_at) for r in access.sync_profiles(users, new, NOW).collect()}
    assert got == {"a": ("A2", "a@x", "pic", NOW), "b": ("B", "b@x", "i", old)}


def test_create_org_and_namespace(spark, world):
    m, _ = world
    out = access.create_orgs(spark.createDataFrame([("own", "  Acme ")], "user_id string, name string"), NOW)
    assert [(r.org_name, r.role) for r in out["returning"].collect()] == [("Acme", "owner")]
    orgs = out["orgs"].unionByName(spark.createDataFrame([("o", "Old", NOW)], "id string, name string, created_at timestamp"))
    both = m.unionByName(out["org_memberships"].select("org_id", "user_id", "role"))
    assert {r.org_name for r in access.user_orgs(both, orgs, "own").collect()} == {"Acme", "Old"}
    assert access.org_by_id(both, orgs, "mem", out["orgs"].first().id).collect() == []
    asked = spark.createDataFrame([("o", "own", "team"), ("o", "mem", "lab"), ("o", "own", "default")], "org_id string, user_id string, name string")
    made = access.create_namespaces(asked, m, spark.createDataFrame([("o", "default")], "org_id string, name string"), NOW)
    assert [(r.org_id, r.name) for r in made["namespaces"].collect()] == [("o", "team")]
    assert [(r.user_id, r.namespace) for r in made["namespace_permissions"].collect()] == [("own", "team")]


def test_requests_become_episodes_and_jobs(spark):
    bodies = [("r1", '{"text":"Hello"}'), ("r2", '{"text":""}'), ("r3", "nope"), ("r4", '{"text":"x","namespace":"team","sessionId":"s"}')]
    df = spark.createDataFrame([("t", "u", *b) for b in bodies], "tenant_id string, user_id string, request_id string, body string")
    out = requests.accept(requests.parse_requests(df), NOW)
    assert {(r.rawText, r.namespace, r.sessionId) for r in out["jobs"].collect()} == {("Hello", "default", None), ("x", "team", "s")}
    assert {r.request_id for r in out["refused"].collect()} == {"r2", "r3"}
    assert requests.require_episodes(out["jobs"], out["episodes"]).count() == 2
    with pytest.raises(LookupError, match="Episode not found: gone"):
        requests.require_episodes(spark.createDataFrame([("gone",)], "episodeId string"), out["episodes"])
