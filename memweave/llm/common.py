"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts: space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared checkpoint folder: computed once, read without their lineage, dropped when no longer needed.

    The folder is the session's ``spark.checkpoint.dir``, so the tables outlive executors; their size is known to the planner.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def cut(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame, but: DataFrame | None = None) -> None:
        """Delete these tables; with ``but`` all others."""
        kept = []
        for df, path in self.tables:
            if df is but or (but is None and not any(df is t for t in tables)):
                kept.append((df, path))
            else:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.tables = kept


def cut(df: DataFrame, **options: str) -> DataFrame:
    """``df`` computed once into a table of the shared folder, which stays; ``options`` are the writer's."""
    return Scratch(df.sparkSession).cut(df, **options)


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where it is unset and one machine runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL[:] = _LOCAL or [tempfile.mkdtemp(prefix="tables-")]
        found = _LOCAL[0]
    return found.rstrip("/")


#: Keys that a broadcast holds at most: those with more than this part of all rows.
HOT = 10_000


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], scratch: Scratch, how: str | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has each key once and ``n``, how many rows of ``left`` have it.

    Keys with more than one of ``HOT`` rows, of which there can't be ``HOT``, are broadcast, so that none of them meets in one task. ``how`` is a join hint for the others.
    """
    right = scratch.cut(right)
    total = right.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total
    hot = F.broadcast(right.where(often))
    others = right.where(~often)
    rest = left.join(hot.select(*keys), keys, "left_anti").join(others.hint(how) if how else others, keys)
    return left.join(hot, keys).unionByName(rest)


def fold(key, folds: int) -> int:
    """crc32 of the id as text, modulo ``folds``."""
    return zlib.crc32(str(key).encode()) % folds


def fold_col(key: str, folds: int) -> Column:
    """The same as a column; a null id hashes as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once even where a lambda repeats it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def of(docs: DataFrame, name: str) -> Column:
    """A column of ``docs``, or a typed null where it lacks it."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs[name] if name in docs.columns else F.lit(None).cast(kinds[name]).alias(name)


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, with a typed null for a column that ``docs`` lacks."""
    return docs.select(*[of(docs, n) for n in names])
