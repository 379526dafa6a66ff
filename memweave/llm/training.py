"""What the trained operators share: bounded samples of labelled documents, and per-document scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_col, slim

#: Labelled documents of one label that a model is fitted on, at most about as many; bytes of them on the driver.
SAMPLE = 2_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of a reproducible sample of the labelled rows outside fold ``held``: about ``most`` of each label.

    Rows are chosen by a hash of their id, so the sample is spread evenly; null labels and ids are left out. Ids that
    are labelled twice count once, with the smaller label. The chosen ids are bounded, so joining them is a broadcast.
    """
    of = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold_col("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    counts = {r.y: r.n for r in of.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for y, n in sorted(counts.items()) for v in (y, min(1.0, most / n))])
    chosen = of.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    rows = slim(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").collect()
    return [(r.text or "", r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))]


def score_documents(docs: DataFrame, score: Callable[[list[str]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """doc_id and what ``score`` returns for each text, null as empty; columns and types as in ``schema``."""
    kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    columns = [c.split() for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {n: pa.array(found[n], kinds[k]) for n, k in columns})

    return slim(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(task, f"doc_id bigint, {schema}")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with halved steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, -np.where(y > 0, z, -z)).sum() + ridge / 2 * v @ v)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
    return w
