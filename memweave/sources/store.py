"""Append-only snapshot store on Parquet: a batch becomes visible when its marker is written, all tables at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.status import current_claims
from ..schemas import TABLES, struct


class Store:
    """Tables below a path, as ``table/batch_id=N``, and ``_commits`` with one marker for each published batch.

    Writing a batch again replaces it, so a replay after a failure changes nothing else. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _live(self) -> list[tuple[int, str]]:
        """(number, folder) of what is published and was not replaced, in order."""
        if not self._exists(f"{self.path}/_commits"):
            return []
        marks = self.spark.read.schema("batch_id bigint, folder string, replaces array<string>").option("recursiveFileLookup", "true").json(f"{self.path}/_commits").collect()  # one for each batch
        gone = {f for m in marks for f in m.replaces or []}
        return sorted({(m.batch_id, m.folder) for m in marks if m.folder not in gone})

    def batches(self) -> list[int]:
        return sorted({n for n, _ in self._live()})

    def publish(self, batch_id: int, rows: dict[str, DataFrame], folder: str | None = None, replaces: list[str] | None = None) -> None:
        """Write the tables' rows, then the marker, with which they become visible, and what they replace invisible."""
        folder = folder or f"batch_id={batch_id}"
        for name, df in rows.items():
            schema = struct(name)
            cast = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            cast.write.mode("overwrite").parquet(f"{self.path}/{name}/{folder}")
        mark = self.spark.createDataFrame([(batch_id, folder, replaces or [])], "batch_id bigint, folder string, replaces array<string>")
        mark.coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/{folder}")

    def once(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows as first written under a name; later calls read them."""
        path = f"{self.path}/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """The rows of published batches, or of those before a number: what a replay of that batch may see."""
        paths = [p for n, f in self._live() if (before is None or n < before) and self._exists(p := f"{self.path}/{name}/{f}")]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def claims(self, before: int | None = None) -> DataFrame:
        """Claims with their current status, without those that were dropped as duplicates."""
        return current_claims(self.read("memory_claims", before), self.read("claim_status_events", before)).where("status <> 'deleted'")

    def compact(self) -> None:
        """Merge all batches but the last, which may yet be replayed, into one under the number of the newest of them.

        One marker makes the merged rows visible and their sources invisible; files of replaced batches are deleted afterwards.
        """
        old = self._live()[:-1]
        if len(old) < 2:
            return
        last = old[-1][0]
        rows = {n: self.read(n, last + 1) for n in TABLES}
        self.publish(last, {n: df for n, df in rows.items() if df.head(1)}, f"merged={uuid.uuid4().hex}", [f for _, f in old])
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for _, f in old:
            for name in TABLES:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{f}"), True)
