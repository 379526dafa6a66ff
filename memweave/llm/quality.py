"""Quality by Bradley-Terry ranking: document scores learned from preference pairs.

All labelled documents outside the held-out fold are dealt into groups, in which each is paired with documents of the
other label; the log-odds that the good one is preferred are the difference of two linear scores, fitted by logistic
loss on feature differences, summed over all groups. The threshold is a quantile of the scores of all these documents:
that at which their share of bad ones lies below it; scores are mapped so that it stands at ``THRESHOLD``.
Ids that are labelled twice count once, with the smaller label; rows equal in id and text teach once.

Features are read off the whole text: shares of symbols, capitals and digits, repeated words and lines,
and the worst part of ``PART`` words. Defined results: null counts as empty text, which is scored like any
other; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, fold_col, slim

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
PAIRS, RIDGE, PART = 40_000, 40.0, 40
#: Documents of the rarer label, and of the other, in a group, about; partners of each document.
FEWER, MORE, ROUNDS = 1_024, 16_384, 4
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def _share(b: bytes, of: bytes) -> float:
    return (len(b) - len(b.translate(None, of))) / max(1, len(b))


def features(text: str) -> list[float]:
    b = text.encode()
    words = b.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    symbols, upper, pipes = _share(b, SYMBOLS), _share(b, UPPER), _share(b, b"|")
    repeats = sum(map(operator.eq, words, words[1:])) / max(1, n - 1)
    parts = [words[i : i + PART] for i in range(0, n, PART)] or [[]]
    joined = [p for p in map(b" ".join, parts) if len(p) > PART] or [b""]
    return [
        symbols, upper, _share(b, DIGITS), pipes, _share(b, b"!"), _share(b, b"#$%&*"), repeats, len(set(words)) / max(1, n),
        float(np.log1p(n)), len(b) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)),
        symbols**0.5, upper**0.5, pipes**0.5, repeats**0.5,
        max(sum(map(operator.eq, p, p[1:])) / max(8, len(p) - 1) for p in parts),
        max(_share(p, SYMBOLS) for p in joined), max(_share(p, UPPER) for p in joined), max(_share(p, b"|") for p in joined),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.array(features(t or "")).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "x": pa.array(x, pa.binary())})


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, h, x) of every document; h a hash of its id and text, x its features, some 150 bytes in place of the text."""
    rows = slim(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(_featured, "doc_id bigint, h bigint, x binary")


def _labelled(docs: DataFrame, labels: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(h, y, x) of every labelled document outside the held-out fold; ``rows`` is ``featured(docs)`` where that is stored.

    Features are joined, not texts, so no text is shuffled however large ``labels`` is.
    """
    of = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_col("doc_id", FOLDS) != HELD))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    rows = featured(docs) if rows is None else rows
    return rows.where(fold_col("doc_id", FOLDS) != HELD).join(of, "doc_id").select("h", "y", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), len(features("")))


def _summed(df: DataFrame, task, size: int) -> np.ndarray:
    """The sum over all batches of what ``task`` makes of each, an array of ``size`` numbers; a task sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"sums": pa.array([sum((task(b) for b in batches if b.num_rows), np.zeros(size)).tobytes()], pa.binary())})

    found = sorted(r.sums for r in df.mapInArrow(run, "sums binary").collect())
    return sum((np.frombuffer(x) for x in found), np.zeros(size))


def _pairs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the good and the bad document of each pair: each document has ``ROUNDS`` partners at least if there are any."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    k = np.arange(max(len(good), len(bad)))
    return (
        np.concatenate([good[(k + (r * 7 if len(good) < len(bad) else 0)) % len(good)] for r in range(ROUNDS)]),
        np.concatenate([bad[(k + (r * 7 if len(good) >= len(bad) else 0)) % len(bad)] for r in range(ROUNDS)]),
    )


class BradleyTerry:
    """Linear scores in units of the log-odds of being preferred, and the map of them to 0 to 1."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: DataFrame | None = None):
        scratch = Scratch(docs.sparkSession)
        rows = scratch.cut(_labelled(docs, labels, rows).dropDuplicates(["h", "y"]))
        n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        self.fitted = len(n) == 2
        if self.fitted:
            self._fit(rows, n, scratch)
        scratch.drop()

    def _fit(self, rows: DataFrame, n: dict[int, int], scratch: Scratch) -> None:
        size = len(features(""))

        def moments(batch: pa.RecordBatch) -> np.ndarray:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            return np.concatenate([f(x[y == v]) for v in (0, 1) for f in (lambda z: z.sum(axis=0), lambda z: (z * z).sum(axis=0))])

        sums = _summed(rows, moments, 4 * size).reshape(2, 2, size)
        # both labels weigh the same
        self.mean, square = (sum(sums[v, i] / n[v] for v in (0, 1)) / 2 for i in (0, 1))
        self.scale = np.sqrt(np.maximum(square - self.mean**2, 0)) + 1e-6

        few = 0 if n[0] < n[1] else 1
        parts = max(1, n[few] // FEWER)
        copies = max(1, n[1 - few] // (parts * MORE))
        # the rarer label goes to each copy of its part, so that no group has more than about FEWER + MORE documents
        side = F.when(F.col("y") == few, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.pmod(F.xxhash64("h"), F.lit(copies)).cast("int")))
        dealt = rows.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).withColumn("side", F.explode(side))
        lists = F.sort_array(F.collect_list(F.struct("h", "y", "x")))
        groups = scratch.cut(dealt.groupBy("part", "side").agg(lists.alias("rows")).select(F.col("rows.y").alias("y"), F.col("rows.x").alias("x")))

        def step(w: np.ndarray):
            def task(batch: pa.RecordBatch) -> np.ndarray:
                out = np.zeros(1 + size + size * size)
                for y, x in zip(batch.column("y"), batch.column("x"), strict=True):
                    z = self._standard(_matrix(x.values))
                    good, bad = _pairs(np.array(y.as_py()))
                    gap = z[good] - z[bad]
                    p = 1 / (1 + np.exp(-np.clip(gap @ w, -40, 40)))
                    out += np.concatenate(([len(gap)], gap.T @ (1 - p), ((gap * (p * (1 - p))[:, None]).T @ gap).ravel()))
                return out

            return task

        w = np.zeros(size)
        for _ in range(25):
            sums = _summed(groups, step(w), 1 + size + size * size)
            weight = PAIRS / max(1.0, sums[0])
            up = np.linalg.solve(weight * sums[1 + size :].reshape(size, size) + RIDGE * np.eye(size), weight * sums[1 : 1 + size] - RIDGE * w)
            w = w + up
            if np.abs(up).max() < 1e-7:
                break
        self.weights = np.round(w, 6)  # so that sums in another order give the same

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = np.round(self._standard(_matrix(batch.column("x"))) @ self.weights, 9)
                bits = (s + 0.0).view(np.int64)
                yield pa.record_batch({"s": pa.array(s), "bits": pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))})

        scores = scratch.cut(rows.mapInArrow(scored, "s double, bits bigint"))
        # the score of the place n[0] in their order, exactly, 16 bits of it at a time
        place, known, at = n[0], scores, None
        for shift in (48, 32, 16, 0):
            of = F.shiftright("bits", shift)
            counts = sorted((r.k, r.n) for r in known.groupBy(of.alias("k")).agg(F.count("*").alias("n")).collect())
            for k, many in counts:
                if place < many:
                    at = k
                    break
                place -= many
            known = known.where(of == at)
        upper = float(known.agg(F.min("s")).first()[0])
        ends = scores.agg(F.min("s"), F.max("s"), F.max(F.when(F.col("s") < upper, F.col("s")))).first()
        lower = upper if place or ends[2] is None else ends[2]  # the place before it: the same score, or the next lower
        # halfway, so that neither stands on the edge
        self.threshold = (lower + upper) / 2
        self.low, self.high = min(ends[0], self.threshold - 1e-6), max(ends[1], self.threshold + 1e-6)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self._standard(x) * self.weights).sum(axis=1)  # row by row, so that a score doesn't depend on its batch

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features, 0 to 1: THRESHOLD at the threshold, linear on both sides, bent to stay inside beyond the range of the labelled."""
        if not self.fitted:
            return np.full(len(x), 0.5)
        s = self.raw(x)
        up, down = np.maximum(s - self.threshold, 0) / (self.high - self.threshold), np.maximum(self.threshold - s, 0) / (self.threshold - self.low)
        return np.where(s >= self.threshold, THRESHOLD + (1 - THRESHOLD) * (up / (0.05 + up)), THRESHOLD * 0.05 / (0.05 + down))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    rows = cut(featured(docs))
    model = BradleyTerry(docs, labels, rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_matrix(batch.column("x"))), pa.float64())})

    scored = rows.select("doc_id", "x").mapInArrow(task, "doc_id bigint, score double")
    return scored.select("doc_id", (fold_col("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
