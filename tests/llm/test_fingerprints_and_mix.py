"""Syncmer fingerprints and the mix against plain versions."""

import hashlib
import random
from collections import defaultdict

from memweave.llm import mixing, syncmers

from .test_simhash import SCHEMA, documents


def rows_of(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [(i * 3 - 20, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 300])))) for i in range(n)]


def test_edited_text_is_of_the_next_document(spark):
    rows = [*rows_of(60), (1000, None), (1001, "short"), (1002, "é漢字 " * 30)]
    got = {r.doc_id: r for r in syncmers.fingerprint_pairs(documents(spark, rows).withColumnRenamed("lang", "fp")).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 800]
    assert sum(r.near_edited for r in long) / len(long) > 0.2 > sum(r.near_next for r in long) / len(long)


def test_next_is_found_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET", 7)
    rows = [(i * i, f"text {i}") for i in range(90)]
    df = syncmers.with_next(documents(spark, rows), "doc_id", ["text"])
    got = {r.doc_id: r.next_text for r in df.collect()}
    order = sorted(rows, reverse=True)
    assert got == {i: after for (i, _), (_, after) in zip(order, [*order[1:], order[0]], strict=True)}


def test_equal_texts_and_local_edits(spark):
    base = " ".join(f"word{i}" for i in range(200))
    changed = base.replace("word100 ", "other ")
    rows = [(1, base), (2, base), (3, changed), (4, None), (5, "")]
    got = {r.doc_id: r for r in syncmers.fingerprint_pairs(documents(spark, rows)).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[2].near_next == 1.0 and got[3].near_next > 0.9
    assert got[4].fingerprint == got[5].fingerprint == "" and got[5].near_next == 1.0
    a = documents(spark, [(1, base), (3, changed)]).select("doc_id", syncmers.anchors("text").alias("a")).collect()
    one, two = ({(x.pos, x.hash) for x in r.a} for r in a)
    assert len(one - two) <= 5 and len(one & two) > 50


def test_no_rows(spark):
    assert syncmers.fingerprint_pairs(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []


def plain_targets(size, weights=(5, 2, 1)):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * size[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            full.add(s)
        if not [s for s in names if s not in full]:
            return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.choice([0, 1, 5, 30, 700])), "en", rng.choice(["a", "a", "a", "b", "c", None, "é", "z"]), None) for i in range(300)]
    rows += [(5, "x y", "en", "a", None), (None, None, "en", "a", None), (301, "w " * 50_000, "en", "b", None), (302, None, "en", "empty", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert all((r.first_slot < 0) == (r.taken == 0) for r in got)
    # the documents in the schedule's order keep each source near its share all along
    order, upto, whole = sorted((r for r in got if r.taken), key=lambda r: r.first_slot), defaultdict(int), sum(want.values())
    for r in order[: len(order) // 2]:
        upto[r.source] += r.taken
    assert all(abs(upto[s] / max(1, sum(upto.values())) - want[s] / whole) < 0.35 for s in want)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))


def test_schedule_spreads_each_source(spark):
    rows = [(i, "x " * 300, "en", s, None) for i, s in enumerate(["a", "b", "c"] * 200)]
    sized = mixing.sizes(spark.createDataFrame(rows, SCHEMA))
    src = mixing.source_targets(sized, block=64)
    slots = mixing.schedule(src, block=64).collect()
    share = {r.source: r.target / sum(x.target for x in src.collect()) for r in src.collect()}
    first = [r.source for r in sorted(slots, key=lambda r: r.slot)[:200]]
    for s, w in share.items():
        assert abs(first.count(s) - 200 * w) < 4


def test_every_text_with_tokens_has_a_fingerprint(spark):
    texts = [" ".join(f"{c}{i}" for c in "abcdefg"[:n]) for n in (5, 6, 7) for i in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", syncmers.sketch("text").alias("s"), syncmers.anchors("text").alias("a")).collect()
    assert all(r.s and sorted({x["hash"] for x in r.a}) == r.s for r in rows)
    assert len({(r.text.count(" "), *r.s) for r in rows}) == len(texts)
