"""Quality, toxicity and language on small invented texts: held-out accuracy and edge cases."""

import random

import pytest

from memweave.llm import common, langid, quality, toxicity

from .test_simhash import SCHEMA

SYLLABLES = {"en": "th er on an re he in ed nd ha at", "de": "sch ein ich ung keit ver ge", "fr": "eau oux ai tre que ment", "es": "cion ado ar que los mente"}


def text(rng, lang, n=80):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(500):
        lang = rng.choice(list(SYLLABLES))
        words = text(rng, lang, rng.choice([30, 80, 200])).split()
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "worthless", "imbecile"]))
        if not good:
            words = [w + rng.choice(["$$$", "###", "%%%"]) for w in words]
        docs.append((i, " ".join(words), lang if i % 9 else None, "s", None))
        labels.append((i, int(good) if i % 7 else None, int(toxic) if i % 5 else None))
    docs += [(1000, None, "en", "s", None), (1001, "", "en", "s", None), (1002, "123 !!", "en", "s", None), (None, "the and the", "en", "s", None), (3, docs[3][1], docs[3][2], "s", None)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, labels[0], (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def accuracy(spark, scored, labels, label):
    rows = scored.join(labels.select("doc_id", label).where(f"{label} is not null").distinct(), "doc_id").where("held_out").collect()
    assert len(rows) > 30
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality(spark, corpus):
    docs, labels = corpus
    got = quality.quality_scores(docs, labels)
    assert accuracy(spark, got, labels, "quality") > 0.95
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (common.fold(r.doc_id, 5) == 0) for r in rows if r.doc_id is not None)


def test_quality_joins_labels_to_features_not_texts(spark, corpus, tmp_path):
    """Without broadcasts, as with many labels, no text goes through a shuffle."""
    docs, labels = corpus
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality._labelled(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
        got = quality.quality_scores(docs, labels).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    assert not any("text#" in x for x in lines[: next(i for i, x in enumerate(lines) if "MapInArrow" in x)])
    by = lambda rows: sorted((r.doc_id is None, r.doc_id, r.score) for r in rows)
    assert by(got) == by(quality.quality_scores(docs, labels).collect())


def test_toxicity(spark, corpus):
    docs, labels = corpus
    got = toxicity.toxicity_scores(docs, labels)
    assert accuracy(spark, got, labels, "toxic") > 0.9
    rows = {r.doc_id: r for r in got.collect()}
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[1000].predicted == rows[1001].predicted == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_language(spark, corpus):
    docs, _ = corpus
    got = langid.predict_languages(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and doc_id < 1000").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    by = {r.doc_id: r for r in got.collect()}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in by.values())


def test_without_labels_or_rows(spark, corpus):
    docs, labels = corpus
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert quality.quality_scores(docs.where("false"), labels).collect() == []
    assert {r.lang_pred for r in langid.predict_languages(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false")).collect()} == set()


def test_windows_hold_the_whole_text():
    for t in ("", "a b", "x" * 500, "word " * 300, "é" * 200):
        assert b"".join(toxicity.windows(t)) == t.lower().encode()


def test_quality_learns_from_every_labelled_document(spark, corpus, monkeypatch):
    """No document is left out of the fit, in few large groups or in many with copies of the rarer label."""
    docs, labels = corpus
    labelled = quality._labelled(docs, labels)
    want = {r.doc_id: r.quality for r in labels.where("quality is not null and doc_id is not null").collect() if common.fold(r.doc_id, 5)}
    assert sorted(r.y for r in labelled.dropDuplicates(["h"]).collect()) == sorted(want.values())
    seen = []
    monkeypatch.setattr(quality, "FEWER", 20)
    monkeypatch.setattr(quality, "MORE", 30)
    inner = quality._summed
    monkeypatch.setattr(quality, "_summed", lambda df, task, size: (seen.append(df), inner(df, task, size))[1])
    cut = common.Scratch.drop
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *a, **b: None)
    quality.BradleyTerry(docs, labels)
    monkeypatch.setattr(common.Scratch, "drop", cut)
    groups = seen[1].collect()
    few = 0 if sum(want.values()) * 2 > len(want) else 1
    assert len(groups) > 1 and sum(y == 1 - few for g in groups for y in g.y) == sum(v == 1 - few for v in want.values())
    assert len({bytes(x) for g in groups for x in g.x}) == len({bytes(r.x) for r in seen[0].collect()})
    for g in groups:
        good, bad = quality._pairs(quality.np.array(g.y))
        assert set(good) | set(bad) == set(range(len(g.y)))
