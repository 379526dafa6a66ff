"""SimHash near-duplicates of documents: fingerprints over 3-word shingles, linked by a binary trie self-join.

Words are runs without ASCII blanks, after lower-casing A-Z; shingles are three words joined by a
space, repeats included; a shorter text is one shingle of all its words. A fingerprint bit is 1 if set
in over half of the shingles' XXH64 values (seed 42). Fingerprints link at ``K`` or fewer differing bits.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; equal
fingerprints are collapsed before the join, so copies cost nothing there; rows that repeat a doc_id
take part each; a null doc_id gets its fingerprint's component like any other row, and is its id only if no
member has one; an empty table gives an empty result; a text of any length is hashed ``BLOCK`` shingles at a
time; other columns are kept whatever their names.

Near copies at a 5-word likeness of 0.8 and more differ in more bits than ``K``, so ``keep_one`` links at ``NEAR`` by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted_join, of, slim
from .components import connected_components
from .hamming import link_forest

K, NEAR, SHINGLE, SEED = 2, 4, 3, 42
#: Node pairs up to this many codes are traversed inside one task; hashes whose bits are counted at once.
LEAF, BLOCK = 8_192, 4_096


def simhash(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    stop = (begin + size)[-n:].tolist()
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = zip(begin[:n].tolist(), stop, strict=True)
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for at in range(0, n, BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.fromiter((simhash(t.as_py()) for t in batch.column("text").cast(pa.large_binary())), np.uint64, batch.num_rows).view(np.int64)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "code": pa.array(codes)})


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        codes = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "code": pa.array(codes)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, code: the fingerprint as a signed long."""
    return slim(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_fingerprint_batches, "doc_id bigint, code bigint")


def code_groups(codes: DataFrame, k: int, leaf: int, scratch: Scratch) -> DataFrame:
    """codes (code: unique, n) -> (code, group, n): the codes' components; a code without a link is a group of its own."""
    groups = connected_components(link_forest(codes.select(F.col("code").alias("id"), "code"), k, leaf, scratch), scratch)
    return scratch.cut(codes.join(groups.withColumnRenamed("node", "code"), "code", "left").withColumn("group", F.coalesce("component", "code")).drop("component"))


def near_duplicates(docs: DataFrame, k: int = K, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id reachable over links, the document's own included."""
    scratch = Scratch(docs.sparkSession)
    coded = scratch.cut(fingerprints(docs))
    codes = scratch.cut(coded.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    grouped = code_groups(codes, k, leaf, scratch)
    # of each group of codes, the smallest doc_id of any member
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = counted_join(grouped.withColumnRenamed("n", "rows"), least, ["group"], scratch).select("code", "component_id", F.col("rows").alias("n"))
    return counted_join(coded, named, ["code"], scratch).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = NEAR, leaf: int = LEAF) -> DataFrame:
    """The documents without near-duplicates: of each group one row, that with the smallest doc_id, null last; ties go by a hash of the whole row."""
    scratch = Scratch(docs.sparkSession)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    row = F.xxhash64(*hashed)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), of(docs, "doc_id").cast("long").alias("doc_id"), of(docs, "text").alias("text"), row.alias("row"))
    coded = scratch.cut(keyed.select("doc_id", "text", "row").mapInArrow(_row_batches, "doc_id bigint, row bigint, code bigint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    codes = scratch.cut(coded.groupBy("code").agg(first.alias("first"), F.count("*").alias("n")))
    kept = scratch.cut(code_groups(codes, k, leaf, scratch).groupBy("group").agg(F.min("first").alias("first")).select("first.row").distinct())
    scratch.drop(but=kept)
    # rows equal in all columns have one hash, and one of them stays
    once = keyed.join(kept, "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc"))
    return once.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
