"""Hamming-distance self-join of 64-bit codes as a binary trie joined with itself.

Codes within ``k`` bits of each other agree on at least one of ``k + 1`` blocks of bits. For each block
the code is rotated so that the block comes first, which makes a trie whose nodes at that depth hold
the codes that share the block: a pair of such nodes has spent no errors. From there node pairs are
traversed together, bit by bit, adding differing bits and dropping a pair beyond the budget. Node
pairs with more than ``leaf`` codes are split over the cluster, ``STEP`` bits at a time; smaller ones
are traversed to the leaves inside one task.

The result is not all pairs but a forest: edges that connect exactly what the links connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITS, STEP = 64, 8
#: What names a node pair: the rotation, the depth, the path of its first node, and the bits in which the other path differs.
KEY = ("rot", "depth", "node", "x")
#: Bound on the node pairs that a traversal extends, and the codes that it compares, at once.
AT_ONCE = 200_000
#: A pair of nodes with no more pairs of codes than this is a leaf, whose codes are compared one by one.
FEW = 2_048


def pairs_within(code: np.ndarray, lo_a, hi_a, lo_b, hi_b, err, depth: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs of uint64 codes within ``k`` bits, by traversing pairs of trie nodes together.

    A node is a range of ``code`` that is sorted and shares its first ``depth`` bits; the arrays name the pairs of nodes to
    start from and the bits in which their paths differ. A node paired with itself gives each pair of its codes once. No
    more than about ``AT_ONCE`` node pairs are held for each bit.
    """
    todo = [(BITS - 1 - depth, *map(np.asarray, (lo_a, hi_a, lo_b, hi_b, err)))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        bit, lo_a, hi_a, lo_b, hi_b, err = todo.pop()
        if not len(lo_a):
            continue
        if len(lo_a) > AT_ONCE:
            todo += [(bit, *(c[i : i + AT_ONCE] for c in (lo_a, hi_a, lo_b, hi_b, err))) for i in range(0, len(lo_a), AT_ONCE)]
            continue
        few = ((hi_a - lo_a) * (hi_b - lo_b) <= FEW) | (bit < 0)
        yield from _compared(code, lo_a[few], hi_a[few], lo_b[few], hi_b[few], k)
        lo_a, hi_a, lo_b, hi_b, err = lo_a[~few], hi_a[~few], lo_b[~few], hi_b[~few], err[~few]
        if not len(lo_a):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((code & np.uint64(1 << bit)) != 0, dtype=np.int32)))
        n = ones[bit]
        # a node's codes are sorted, so those with this bit set are its tail
        mid_a, mid_b = hi_a - (n[hi_a] - n[lo_a]), hi_b - (n[hi_b] - n[lo_b])
        once = np.where((lo_a == lo_b) & (hi_a == hi_b), k + 1, err + 1)
        lo_a, hi_a, lo_b, hi_b, err = (
            np.concatenate((lo_a, mid_a, lo_a, mid_a)), np.concatenate((mid_a, hi_a, mid_a, hi_a)),
            np.concatenate((lo_b, mid_b, mid_b, lo_b)), np.concatenate((mid_b, hi_b, hi_b, mid_b)),
            np.concatenate((err, err, err + 1, once)),
        )
        keep = (err <= k) & (hi_a > lo_a) & (hi_b > lo_b) & ~((lo_a == lo_b) & (hi_a - lo_a == 1))
        todo.append((bit - 1, lo_a[keep], hi_a[keep], lo_b[keep], hi_b[keep], err[keep]))


def _compared(code: np.ndarray, lo_a, hi_a, lo_b, hi_b, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaf nodes' codes within ``k`` bits, about ``AT_ONCE`` comparisons at a time."""
    width = hi_b - lo_b
    todo = (hi_a - lo_a) * width
    part = np.cumsum(todo) // AT_ONCE
    for one in np.unique(part):
        at = np.flatnonzero(part == one)
        n = todo[at]
        of = np.repeat(at, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = lo_a[of] + place // width[of], lo_b[of] + place % width[of]
        near = (i < j) & (np.bitwise_count(code[i] ^ code[j]) <= k)
        yield i[near], j[near]


def forest(n: int, batches: Iterator[tuple[np.ndarray, np.ndarray]], check: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Of the links (i, j), those that join what was not joined before; ``check`` may refuse a link."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    out = []
    for i, j in batches:
        new = root[i] != root[j]  # most links of a dense group are within one tree already
        for p, q in zip(i[new].tolist(), j[new].tolist(), strict=True):
            u, v = find(p), find(q)
            if u != v and (check is None or check(p, q)):
                root[u] = v
                out.append((p, q))
        if new.any():
            while not np.array_equal(root, up := root[root]):
                root[:] = up
    return out


def _join_nodes(k: int) -> Callable:
    """Arrow batches of rows sorted by node pair -> edges. A node pair may go on in the next batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(parts)
            key = [rows[c].to_numpy() for c in KEY]
            side = rows["side"].to_numpy()
            code = rows["code"].to_numpy().view(np.uint64)
            new = np.zeros(len(code), bool)
            for c in key:
                new[1:] |= c[1:] != c[:-1]
            order = np.lexsort((code, side, np.cumsum(new)))
            side, code, ids = side[order], code[order], rows["id"].to_numpy()[order]
            lo, hi = np.concatenate(([0], np.flatnonzero(new))), np.concatenate((np.flatnonzero(new), [len(ids)]))
            x = key[3][lo].view(np.uint64)
            # side 0 ends where side 1 begins; a node paired with itself has side 0 only
            split, cross = hi - np.add.reduceat(side, lo), x != 0
            some = hi - lo > 1
            start = (lo[some], np.where(cross, split, hi)[some], np.where(cross, split, lo)[some], hi[some], np.bitwise_count(x[some]).astype(np.int64))
            depth = key[1][lo][some]  # rotations, and so node pairs, differ in it
            pairs = chain.from_iterable(pairs_within(code, *(c[depth == d] for c in start), int(d), k) for d in np.unique(depth))
            found = [(ids[p], ids[q]) for p, q in forest(len(ids), pairs)]
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch)
            key = [rows[c].to_numpy() for c in KEY]
            first, end = [tuple(int(c[i]) for c in key) for i in (0, -1)]
            # the last node pair of the batch may go on
            other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in key]))
            cut_at = int(other[-1]) + 1 if len(other) else 0
            if cut_at:
                yield from flush([*held, rows.slice(0, cut_at)])
                held = []
            elif held and last != first:
                yield from flush(held)
                held = []
            held.append(rows.slice(cut_at))
            last = end
        if held:
            yield from flush(held)

    return task


def link_forest(codes: DataFrame, k: int, leaf: int, scratch: Scratch | None = None) -> DataFrame:
    """codes (id: bigint unique, code: bigint unique) -> edges (a, b) that connect what links connect, pairs within ``k`` bits.

    The codes differ, so a node of full depth holds one, and no node pair is compared at more than about ``FEW`` places.
    """
    scratch = scratch or Scratch(codes.sparkSession)
    cut = scratch.cut
    ends = [round(BITS * i / (k + 1)) for i in range(k + 2)]
    rotations = F.explode(F.array(*[F.struct(F.lit(r).alias("rot"), F.lit(ends[r]).alias("turn"), F.lit(ends[r + 1] - ends[r]).alias("depth")) for r in range(k + 1)]))
    turned = F.expr("if(p.turn = 0, code, shiftleft(code, p.turn) | shiftrightunsigned(code, 64 - p.turn))")
    rows = (
        codes.select("id", "code", rotations.alias("p"))
        .select("id", "p.rot", "p.depth", turned.alias("code"))
        .withColumns({"node": F.expr("shiftrightunsigned(code, 64 - depth)"), "x": F.lit(0).cast("long"), "side": F.lit(0)})
    )
    key = list(KEY)
    edges = None
    while True:
        # at the full depth all codes of a node pair are within the budget
        large = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > leaf) & (F.col("depth") < BITS)).drop("n"))
        some = bool(large.head(1))
        here = rows.join(large, key, "left_anti") if some else rows
        found = cut(here.repartition(*key).sortWithinPartitions(*key).mapInArrow(_join_nodes(k), "a bigint, b bigint"))
        edges = found if edges is None else edges.unionByName(found)
        if not some:
            return edges
        rows = cut(_children(rows.join(large, key, "left_semi"), k, scratch))


def _children(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Rows of node pairs, dealt to the pairs of their child nodes that exist and keep the budget, ``STEP`` bits further down.

    A node has at most 2**STEP children, so they are counted first and paired by themselves; each row then goes to its child's pairs.
    """
    step = F.least(F.lit(STEP), F.lit(BITS) - F.col("depth"))
    own = F.expr("shiftrightunsigned(code, 64 - (depth + step))")
    r = rows.withColumn("step", step).where("step > 0").withColumn("path", own)
    nodes = scratch.cut(r.groupBy(*KEY, "side", "path").agg(F.count("*").alias("n")))
    a = nodes.where("side = 0").select(*KEY, F.col("path").alias("pa"), F.col("n").alias("na"))
    b = nodes.select(*KEY, "side", F.col("path").alias("pb"), F.col("n").alias("nb"))
    pairs = (
        a.join(b, list(KEY)).where("(x = 0 and pa <= pb) or (x <> 0 and side = 1)")
        .where(f"bit_count(pa ^ pb) <= {k} and (pa <> pb or na > 1)")
        .select(*KEY, "pa", "pb")
    )
    to = pairs.select(*KEY, F.explode(F.expr("if(pa = pb, array(struct(pa as path, 0 as as_side)), array(struct(pa as path, 0 as as_side), struct(pb as path, 1 as as_side)))")).alias("p"), "pa", "pb")
    to = to.select(*KEY, F.col("p.path").alias("path"), F.col("p.as_side").alias("as_side"), F.col("pa").alias("child"), F.expr("pa ^ pb").alias("differ"))
    met = r.join(to, [*KEY, "path"]).where("x = 0 or side = as_side")
    return met.select(
        "rot", (F.col("depth") + F.col("step")).alias("depth"), F.col("child").alias("node"), F.col("differ").alias("x"), F.col("as_side").alias("side"),
        "id", "code",
    )
