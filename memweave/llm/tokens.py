"""Edit-aware token counts: a segment tree of pre-tokens per document, of which edits re-encode a part.

A text falls into pre-tokens by the tokenizer's pattern, and each is encoded by itself, so a text's count
is the sum over its pre-tokens. The tree's leaves are runs of about ``LEAF`` pre-tokens; every node holds
the characters and tokens below it. An edit is located by descending the tree. Matching starts over one
pre-token before the one that the edit touches, as a match may look one character ahead, and ends where
a new border meets an old one behind the edit: from there on matches depend on later text alone, so they
are as before. Only what lies between is encoded, and only the paths above changed leaves are summed anew.

Trees are rows of a table: ``build_trees`` encodes whole texts once, ``apply_edits`` takes such a table and one of edits
and returns the trees after them, without encoding the rest again.

Defined results: null text counts as empty with no token; edits of an empty text are insertions. Edits beyond a text's end
are clamped to it; a null place or text of an edit is 0 or empty. Edits of one document apply in order of seq, then begin, end and new, each to
the text as the one before left it, a repeated row again; they have to follow one another, so those of one document meet in
one task. They apply to every row with their doc_id; edits without id or of unknown documents apply to nothing. An empty table
gives an empty one. A very long text is one row, held whole with about 70 bytes for each pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slim

#: The vocabulary by default: ranks of a byte-level BPE, installed on the driver; executors get its contents.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer's pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, CACHED = 32, 200_000


class Counter:
    """Token counts of single pre-tokens, those of short ones remembered."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(piece) <= 32:
                self.known[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@lru_cache(maxsize=2)
def counter(vocabulary: bytes) -> Counter:
    return Counter(vocabulary)


class SegmentTree:
    """The token count of a text that is edited in place."""

    def __init__(self, text: str, count: Counter):
        self.count, self.text, self.encoded = count, text, 0
        self._build([(len(p), count(p)) for p in count.split(text)])

    @classmethod
    def restore(cls, text: str, count: Counter, sizes: list[int], pieces: list[tuple[int, int]], chars: list[int], tokens: list[int]) -> SegmentTree:
        """A stored tree: pre-tokens of each leaf, all pre-tokens, and the sums of its nodes."""
        tree = cls.__new__(cls)
        tree.count, tree.text, tree.encoded, tree.width = count, text, 0, len(chars) // 2
        ends = list(accumulate(sizes))
        tree.leaves = [pieces[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        tree.chars, tree.tokens = chars, tokens
        return tree

    def _build(self, pieces: list[tuple[int, int]]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i in range(len(self.leaves)):
            self._sum_leaf(i)
        for i in range(self.width - 1, 0, -1):
            self._sum_node(i)

    def _sum_leaf(self, i: int) -> None:
        self.chars[self.width + i] = sum(c for c, _ in self.leaves[i])
        self.tokens[self.width + i] = sum(t for _, t in self.leaves[i])

    def _sum_node(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _locate(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``, the last one at the end of the text."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end."""
        size = len(self.text)
        start, end = max(0, min(start, size)), max(0, min(end, size))
        end = max(start, end)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        leaf, at = self._locate(max(0, start - 1))
        # the pre-token before the one that holds the last character before the edit
        place, p = 0, at
        while place < len(self.leaves[leaf]) and p + self.leaves[leaf][place][0] < start:
            p += self.leaves[leaf][place][0]
            place += 1
        if place:
            place -= 1
            p -= self.leaves[leaf][place][0]
        else:
            while leaf and not place:
                leaf -= 1
                place = len(self.leaves[leaf])
            if place:
                place -= 1
                p -= self.leaves[leaf][place][0]
        # match on until a new border is an old one behind the edit
        last, old_leaf, old_place, old = p, leaf, place, p
        fresh: list[tuple[int, int]] = []
        for m in self.count.pattern.finditer(text, p):
            if last - shift >= end and last > p:
                while old < last - shift:
                    if old_place >= len(self.leaves[old_leaf]):
                        old_leaf, old_place = old_leaf + 1, 0
                        continue
                    old += self.leaves[old_leaf][old_place][0]
                    old_place += 1
                if old == last - shift:
                    break
            piece = m.group()
            fresh.append((len(piece), self.count(piece)))
            self.encoded += 1
            last = m.end()
        else:
            old_leaf, old_place = len(self.leaves) - 1, len(self.leaves[-1])
        self.text = text
        if old_leaf == leaf:
            self.leaves[leaf][place:old_place] = fresh
            changed = [leaf]
        else:
            self.leaves[leaf][place:] = fresh
            self.leaves[old_leaf][:old_place] = []
            changed = list(range(leaf, old_leaf + 1))
            for i in changed[1:-1]:
                self.leaves[i] = []
        if len(self.leaves[leaf]) > 8 * LEAF:
            self._build([p for own in self.leaves for p in own])
            return
        for i in changed:
            self._sum_leaf(i)
        above = {(self.width + i) // 2 for i in changed}
        while above and above != {0}:
            for i in above:
                self._sum_node(i)
            above = {i // 2 for i in above}


#: Columns of a stored tree: pre-tokens of each leaf; characters and tokens of each pre-token; sums of each node, the root at 1.
TREE = {"leaf_sizes": "int", "piece_chars": "int", "piece_tokens": "int", "node_chars": "bigint", "node_tokens": "bigint"}
SCHEMA = "doc_id bigint, text string, " + ", ".join(f"{n} array<{k}>" for n, k in TREE.items()) + ", reencoded bigint"
#: Documents of one Arrow batch of trees.
ROWS = 256


def _rows(ids: pa.Array, trees: list[SegmentTree]) -> pa.RecordBatch:
    def lists(rows: Iterator[list[int]], kind: str) -> pa.Array:
        flat, ends = [], [0]
        for row in rows:
            flat += row
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32() if kind == "int" else pa.int64()))

    parts = {
        "leaf_sizes": ([len(own) for own in t.leaves] for t in trees),
        "piece_chars": ([c for own in t.leaves for c, _ in own] for t in trees),
        "piece_tokens": ([n for own in t.leaves for _, n in own] for t in trees),
        "node_chars": (t.chars for t in trees),
        "node_tokens": (t.tokens for t in trees),
    }
    columns = {"doc_id": ids, "text": pa.array([t.text for t in trees], pa.string())}
    columns |= {n: lists(parts[n], k) for n, k in TREE.items()}
    return pa.record_batch(columns | {"reencoded": pa.array([t.encoded for t in trees], pa.int64())})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver
        return docs.sparkSession.sparkContext.broadcast(f.read())


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The tree of each document, every pre-token encoded: a table to keep and to edit."""
    ranks = _vocabulary(docs, vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        for batch in _parts(batches):
            yield _rows(batch.column("doc_id"), [SegmentTree(t or "", count) for t in batch.column("text").to_pylist()])

    return slim(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(task, SCHEMA)


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``trees`` after ``edits`` (doc_id, seq, begin, end, new); ``reencoded`` counts the pre-tokens that were encoded for them."""
    steps = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(c).cast("long").alias(c) for c in ("seq", "begin", "end")], F.col("new").cast("string").alias("new")).alias("e"))
    steps = steps.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("edits"))
    ranks = _vocabulary(trees, vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        for batch in _parts(batches):
            yield _rows(batch.column("doc_id"), [_apply(*pair) for pair in _restored(batch, count)])

    return trees.select("doc_id", "text", *TREE).join(steps, "doc_id", "left").select("doc_id", "text", *TREE, "edits").mapInArrow(task, SCHEMA)


def _restored(batch: pa.RecordBatch, count: Counter) -> Iterator[tuple[SegmentTree, list[dict]]]:
    def lists(name: str) -> Iterator[list[int]]:
        ends, values = batch.column(name).offsets.to_numpy(), batch.column(name).values.to_numpy()
        return (values[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False))

    for text, sizes, chars, tokens, node_chars, node_tokens, steps in zip(batch.column("text").to_pylist(), *map(lists, TREE), batch.column("edits").to_pylist(), strict=True):
        yield SegmentTree.restore(text or "", count, sizes, list(zip(chars, tokens, strict=True)), node_chars, node_tokens), steps or []


def _apply(tree: SegmentTree, steps: list[dict]) -> SegmentTree:
    for e in steps:
        tree.edit(e["begin"] or 0, e["end"] or 0, e["new"] or "")
    return tree


def sample_edits(text: Column) -> Column:
    """Three edits, each of the text as the one before left it: a word inserted in the middle, a stretch cut at a quarter, the end rewritten."""
    n, word = F.length(F.coalesce(text, F.lit(""))).cast("long"), " edited"

    def part(of: int, most: int | None = None) -> Column:
        found = F.floor(n / of)
        return found if most is None else F.least(F.lit(most).cast("long"), found)

    steps = [
        (part(2), part(2), word), (part(4), part(4) + part(8, 40), ""),
        (n + len(word) - part(8, 40) - part(4, 10), n + len(word), "; revised 2 times."),
    ]
    return F.array(*[F.struct(b.cast("long").alias("begin"), e.cast("long").alias("end"), F.lit(new).alias("new")) for b, e, new in steps])


def edited_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, edited_sha256, edited_tokens, reencoded: counts of stored trees before and after the sample edits.

    Edits of the query are functions of the text, so they stand beside each tree and need no join.
    """
    trees = cut(build_trees(docs, vocabulary).drop("reencoded"), compression="zstd").withColumn("edits", sample_edits(F.col("text")))
    ranks = _vocabulary(docs, vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        for batch in _parts(batches):
            rows = []
            for tree, steps in _restored(batch, count):
                before = (sum(map(len, tree.leaves)), tree.total)
                _apply(tree, steps)
                rows.append((*before, hashlib.sha256(tree.text.encode()).hexdigest(), tree.total, tree.encoded))
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})

    kinds = {"n_pretokens": pa.int64(), "n_tokens": pa.int64(), "edited_sha256": pa.string(), "edited_tokens": pa.int64(), "reencoded": pa.int64()}
    schema = "doc_id bigint, n_pretokens bigint, n_tokens bigint, edited_sha256 string, edited_tokens bigint, reencoded bigint"
    return trees.select("doc_id", "text", *TREE, "edits").mapInArrow(task, schema)
