"""The trie self-join and its groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from memweave.llm import components, hamming, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_simhash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, "one", "Two Words", "A b C d É f", "x y z\tq\nr s t u", "a " * 9000])
def test_simhash_matches_plain(text):
    assert simhash.simhash(text.encode() if text is not None else None) == plain_simhash(text)


@pytest.mark.parametrize("leaf", [8, 2000])
def test_link_forest_connects_what_links_connect(spark, leaf):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    codes = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 2**64 - 1}
    for c in centres:
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                c ^= 1 << b
            codes.add(c)
    codes = sorted(codes)
    signed = [int(np.uint64(c).view(np.int64)) for c in codes]
    df = spark.createDataFrame([(c, c) for c in signed], "id bigint, code bigint")
    edges = [(r.a, r.b) for r in hamming.link_forest(df, 2, leaf).collect()]
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert {tuple(sorted(e)) for e in edges} <= {tuple(sorted(e)) for e in links}
    assert plain_groups(signed, edges) == plain_groups(signed, links)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(3, 3), (60, 61), (61, 62), (62, 60), (62, 60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == plain_groups(nodes, [x for x in links if x[0] != x[1]])


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (9, None)]
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        for j in range(4):
            t = list(base)
            for _ in range(j and rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((100 - i + 200 * j, " ".join(t)))
    prints = {i: plain_simhash(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_groups(prints, links)
    got = simhash.near_duplicates(documents(spark, rows).withColumn("code", F.lit(1)).withColumn("id", F.lit(2))).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    kept = simhash.keep_one(documents(spark, rows), k=2)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.NEAR]
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()) == sorted(set(plain_groups(prints, links).values()))


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q r s t u v")]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect() if r.doc_id is not None)
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2)]
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert [r.doc_id for r in simhash.keep_one(documents(spark, rows)).orderBy("doc_id").collect()] == [1, 2]
    assert simhash.keep_one(documents(spark, [])).collect() == []


def test_one_id_on_two_texts_loses_none(spark):
    rows = [(3, "q r s t u"), (5, "a text of its own"), (5, "q r s t u"), (None, "another one that has no id"), (None, "another one that has no id")]
    names = {n: F.lit(1) for n in ("row", "code", "doc", "group", "first", "n")}
    got = simhash.keep_one(documents(spark, rows).withColumns(names).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).collect()
    assert sorted((r.doc_id or -1, r.text, r.row) for r in got) == [(-1, "another one that has no id", 1), (3, "q r s t u", 1), (5, "a text of its own", 1)]


def test_many_copies_of_one_text(spark):
    rows = [(i, "the same text in all of them") for i in range(300)] + [(i, f"w{i} x{i * 7} y{i * 11} z{i * 13} v{i * 17}") for i in range(300, 340)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows).repartition(5), leaf=8).collect()}
    prints = {i: plain_simhash(t) for i, t in rows}
    links = [(min(a, b), max(a, b)) for a in range(299, 340) for b in range(299, a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_groups(prints, links + [(0, i) for i in range(1, 300)])
    assert got == want


def test_very_long_text():
    text = " ".join(f"w{i % 777}" for i in range(100_000))
    assert simhash.simhash(text.encode()) == plain_simhash(text)


def test_node_pairs_of_several_depths_in_one_batch(monkeypatch):
    monkeypatch.setattr(hamming, "FEW", 0)
    rng = random.Random(8)
    rows = []
    for rot, depth in ((0, 29), (1, 30), (2, 29)):
        for _ in range(40):
            node, below = rng.getrandbits(depth), 64 - depth
            x = rng.choice([0, 1, 1, 1 << rng.randrange(depth), 3])
            base = rng.getrandbits(below)
            for side, path in ((0, node), (1, node ^ x)) if x else ((0, node),):
                for _ in range(3):
                    code = path << below | base ^ rng.choice([0, 1 << rng.randrange(below), 1 << below - 1, 3])
                    rows.append((rot, depth, node, x, side, len(rows), int(np.uint64(code).view(np.int64))))
    rows.sort(key=lambda r: r[:4])
    names = ["rot", "depth", "node", "x", "side", "id", "code"]
    batch = pa.record_batch({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
    edges = [e for out in hamming._join_nodes(2)(iter([batch])) for e in zip(*out.to_pydict().values(), strict=True)]
    near = lambda a, b: ((a[6] ^ b[6]) & (2**64 - 1)).bit_count() <= 2 and a[:4] == b[:4] and (a[3] == 0 or a[4] != b[4])
    links = [(a[5], b[5]) for i, a in enumerate(rows) for b in rows[:i] if near(a, b)]
    assert plain_groups(range(len(rows)), edges) == plain_groups(range(len(rows)), links)
