"""Language ID in two steps: the language family, then one-versus-one linear support vector machines within it.

Features are hashed byte bigrams and trigrams of the whole lower-cased text, square-rooted and scaled to
unit length. The family is the best of one-versus-rest machines over families; related languages are told
apart by a machine for each pair, and the language with most votes (then the larger margins) wins.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text where no
language could be learned. A language whose code is in no family listed is a family of its own. Repeated rows
are predicted each, equal texts alike; ties of votes and margins go to the first language by name; an empty table
gives an empty result; texts of any length are read whole, a document of the labelled sample up to ``SAMPLE_CHARS``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_col, slim
from .training import score_documents

FOLDS, HELD = 4, 2
#: Of the labelled sample: documents of a language, in all, languages that are learned (the most frequent), and characters learned of one document.
DIM, PER_LANGUAGE, ALTOGETHER, LANGUAGES, SAMPLE_CHARS = 4_096, 1_000, 12_000, 400, 20_000
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "indic": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def features(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E37_79B1) + b[1:] * np.uint32(0x85EB_CA77)
    three = two[:-1] * np.uint32(0xC2B2_AE3D) + b[2:] * np.uint32(0x27D4_EB2F)
    x = np.concatenate((two, three))
    x ^= x >> np.uint32(15)
    x = (x * np.uint32(0x2C1B_3C6D)) >> np.uint32(32 - DIM.bit_length() + 1)
    f = np.sqrt(np.bincount(x, minlength=DIM).astype(np.float32))
    return f / max(1e-9, float(np.linalg.norm(f)))


def fit_svm(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-3, steps: int = 80, rate: float = 0.2) -> np.ndarray:
    """Weights, the intercept last, by accelerated descent on the squared hinge loss."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    v = w.copy()
    for _ in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ v[:-1] + v[-1])) * sign / len(sign)
        new = v + rate * (2 * np.append(x.T @ slack, slack.sum()).astype(np.float32) - ridge * v)
        v = new + np.float32(0.9) * (new - w)
        w = new
    return w


class Hierarchy:
    def __init__(self, sample: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in sample})
        if not self.languages:
            return
        x = np.stack([features(t) for t, _ in sample])
        lang = np.array([v for _, v in sample])
        family = np.array([FAMILY.get(v, f"own {v}") for v in lang])
        self.families = sorted(set(family))
        machines = []
        if len(self.families) > 1:
            machines += [fit_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families]
        self.members = [sorted(set(lang[family == f])) for f in self.families]
        self.pairs = []
        for members in self.members:
            own = []
            for a, b in combinations(members, 2):
                at = (lang == a) | (lang == b)
                own.append((members.index(a), members.index(b), len(machines)))
                machines.append(fit_svm(x[at], np.where(lang[at] == a, 1, -1).astype(np.float32)))
            self.pairs.append(own)
        self.weights = np.stack(machines) if machines else np.zeros((0, DIM + 1), np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        m = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        at, sure = 0, 1.0
        if len(self.families) > 1:
            e = np.exp(2 * (m[: len(self.families)] - m[: len(self.families)].max()))
            at = int(e.argmax())
            sure = float(e[at] / e.sum())
        members = self.members[at]
        votes, margins = np.zeros(len(members)), np.zeros(len(members))
        for a, b, k in self.pairs[at]:
            votes[a if m[k] >= 0 else b] += 1
            margins[a] += m[k]
            margins[b] -= m[k]
        best = max(range(len(members)), key=lambda i: (votes[i], margins[i]))
        for a, b, k in self.pairs[at]:
            if best in (a, b):
                sure *= float(1 / (1 + np.exp(-2 * (m[k] if best == a else -m[k]))))
        return members[best], min(1.0, max(0.0, sure))


def train(docs: DataFrame) -> Hierarchy:
    """On at most about ``PER_LANGUAGE`` documents of each language, ``ALTOGETHER`` in all, chosen by a hash of their id."""
    known = slim(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_col("doc_id", FOLDS) != HELD))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Hierarchy([])
    often = dict(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:LANGUAGES])
    most = min(PER_LANGUAGE, ALTOGETHER // len(often))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(often.items()) for v in (lang, min(1.0, most / n))])
    # a row is chosen by its id and text, so that rows without an id are spread like any other
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows = chosen.select("doc_id", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), "lang").collect()
    rows = [r for r in rows if any(map(str.isalpha, r.text))]
    return Hierarchy([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text))])


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    model = train(docs)

    def score(texts: list[str]) -> dict:
        found = [model.predict(t) for t in texts]
        return {"lang_pred": [p for p, _ in found], "score": [s for _, s in found]}

    return score_documents(docs, score, "lang_pred string, score double").select("doc_id", (fold_col("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
