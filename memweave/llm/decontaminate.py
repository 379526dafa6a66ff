"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

A text is a sequence of tokens: numbers are ``<number>``, units after a number ``<unit>``, capitalised
words inside a sentence ``<name>``, other words themselves, without case or punctuation. Windows of
``WINDOW`` tokens with at least ``CONTENT`` that are no placeholders are joined by hash with those of the
benchmark's items, in a second template also with capitalised words at a sentence's start as names. An
item's other windows, and items of fewer than ``WINDOW`` tokens as one window, are joined on their literal
tokens with all windows of documents. Along one alignment of a document with an item, each slot value of the item must
stand for one value of the document; inconsistent alignments count for nothing. A document is
contaminated by an item if consistent windows cover half of the item's or ``ENOUGH`` of them. The two
templates are aligned apart; windows of either count.

A bitmap of the item windows' hashes, of one size whatever the benchmark, keeps windows that cannot
match from being joined. Defined results: null texts and items without tokens have no window; a short item
contaminates every text that holds its tokens in a row, so an item of one word all texts with the word; rows equal in doc_id and text are one document;
items with equal templates and slots are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slim
from .hashing import span_hashes

WINDOW, CONTENT, SHARE, ENOUGH = 8, 5, 0.5, 43
BITMAP = 1 << 24
#: Bytes of text that are hashed together.
CHUNK = 1 << 17
#: Units of measure that are slots after a number.
UNITS = (
    "mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs "
    "pound pounds ml cl l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months "
    "year years cent cents dollar dollars usd euro euros eur gbp yen percent degree degrees celsius fahrenheit kelvin watt watts kw kwh volt volts "
    "amp amps hz khz mhz ghz byte bytes kb mb gb tb"
).split()
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DIGIT, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_DIGIT[48:58] = True
_STOP[list(b".!?:;\n\x00")] = True
_NUMBER, _UNIT, _NAME = (np.uint64(0x1111_2222_3333_4440 + i) for i in (1, 2, 3))
#: Sets the hashes of literal windows apart.
_LITERAL = np.uint64(0x5555_6666_7777_8888)


def _hash_tokens(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(low.astype(np.uint64), begin, end)


def _word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(_hash_tokens(b, np.array([0]), np.array([len(b)]))[0])


_UNIT_HASHES = np.sort(np.array([_word_hash(u) for u in UNITS], np.uint64))


def template(texts: list[bytes], initial: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, template token, token as it stands) of every token, tokens as hashes; with ``initial`` names also start sentences."""
    data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8).copy()
    high = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1  # capitals of Latin-1
    low[high] += 0x20
    word, digit = _WORD[data], _DIGIT[data]
    inner = np.flatnonzero(((data[1:-1] == 44) | (data[1:-1] == 46)) & digit[:-2] & digit[2:]) + 1  # 1,000 and 3.5
    word = word.copy()
    word[inner] = True
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.cumsum(data == 0)[begin]
    own = _hash_tokens(low, begin, end)
    if not len(begin):
        return text, own, own
    digits = np.concatenate(([0], np.cumsum(digit)))
    number = digits[end] > digits[begin]
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    start = np.ones(len(begin), bool)
    start[1:] = stops[begin[1:]] > stops[end[:-1]]
    capital = low[begin] != data[begin]
    capital |= (data[begin] == 0xC3) & (low[begin + 1] != data[begin + 1])
    second = np.where(data[begin] == 0xC3, begin + 2, begin + 1)
    name = capital & (~start | initial) & (second < end) & (data[np.minimum(second, len(data) - 1)] == low[np.minimum(second, len(data) - 1)])
    unit = np.zeros(len(begin), bool)
    unit[1:] = number[:-1] & ~start[1:] & np.isin(own[1:], _UNIT_HASHES)
    return text, np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, own))), own


def _spans(text: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of each run of ``size`` tokens of one text."""
    first = np.arange(max(0, len(values) - size + 1))
    first = first[text[first] == text[first + size - 1]] if len(first) else first
    return first, span_hashes(values, first, first + size)


def windows(texts: list[bytes], sizes: list[int] | None) -> Iterator[tuple]:
    """(kind, size, text index, position, hash, first token, slots mask, own hashes) of windows, arrays from the text index on.

    Kinds 0 and 1 are of the two templates. Of items (``sizes`` is None) the windows without enough content and short items are
    literal, of kind 0; of documents the windows of all ``sizes`` are literal besides.
    """
    text, _, own = template(texts)
    begins = np.searchsorted(text, text)  # of each token's text
    none = np.zeros(len(own), bool)
    out = lambda kind, size, at, h, slot: (kind, size, text[at], at - begins[at], h, at, slot, own)
    for kind in (0, 1):
        token = template(texts, bool(kind))[1]
        slot = (token == _NUMBER) | (token == _UNIT) | (token == _NAME)
        at, h = _spans(text, token, WINDOW)
        content = np.concatenate(([0], np.cumsum(~slot)))
        rich = content[at + WINDOW] - content[at] >= CONTENT
        if sizes is not None and kind:  # of documents only those that the first template has otherwise
            other = np.concatenate(([0], np.cumsum(slot != before)))
            rich &= other[at + WINDOW] > other[at]
        before = slot
        yield out(kind, WINDOW, at[rich], h[rich], slot)
        if sizes is None and not kind:
            literal, h = _spans(text, own, WINDOW)
            yield out(0, WINDOW, literal[~rich], h[~rich] ^ _LITERAL, none)
    lengths = np.bincount(text, minlength=len(texts))
    for size in range(1, WINDOW) if sizes is None else sizes:
        at, h = _spans(text, own, size)
        if sizes is None:
            alone = lengths[text[at]] == size
            at, h = at[alone], h[alone]
        yield out(0, size, at, h ^ _LITERAL, none)


def _rows(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None, sizes: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (id, t, text) -> (id, t, kind, size, pos, h, slots) of windows whose bit is set, or all without a bitmap."""
    for batch in batches:
        texts = [(t or "").encode().replace(b"\x00", b" ") for t in batch.column("text").to_pylist()]
        size = np.cumsum([len(t) + 1 for t in texts]) // CHUNK if texts else np.zeros(0)
        for part in np.unique(size):
            rows = np.flatnonzero(size == part)
            for kind, width, text, pos, h, at, slot, own in windows([texts[i] for i in rows], sizes):
                if bitmap is not None:
                    bit = h & np.uint64(BITMAP - 1)
                    hit = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    text, pos, h, at = text[hit], pos[hit], h[hit], at[hit]
                row = pa.array(rows[text])
                values = own.view(np.int64)
                slots = [values[i : i + WINDOW][slot[i : i + WINDOW]].tolist() for i in at.tolist()]
                yield pa.record_batch({
                    "id": batch.column("id").take(row), "t": batch.column("t").take(row), "kind": pa.array(np.full(len(at), kind, np.int32)),
                    "size": pa.array(np.full(len(at), width, np.int32)), "pos": pa.array(pos.astype(np.int32)),
                    "h": pa.array(h.view(np.int64)), "slots": pa.array(slots, pa.list_(pa.int64())),
                })


_SCHEMA = "id bigint, t bigint, kind int, size int, pos int, h bigint, slots array<bigint>"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, t, item_id, n_windows, item_windows, coverage, reworded for each document and item that contaminates it.

    t is the hash of the document's text; reworded tells that some slot value differs from the item's.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    known = cut(items.mapInArrow(lambda b: _rows(b, None), _SCHEMA).distinct())
    sizes = sorted({r["size"] for r in known.select("size").distinct().collect()} | {WINDOW})
    words = known.select(F.pmod("h", F.lit(BITMAP)).alias("bit")).groupBy(F.floor(F.col("bit") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, int(bit % 8))")).alias("v")).toArrow()
    bitmap = np.zeros(BITMAP // 8, np.uint8)  # never larger, whatever the benchmark
    bitmap[words["byte"].to_numpy()] = words["v"].to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    found = d.mapInArrow(lambda b: _rows(b, shared.value, sizes), _SCHEMA).select("id", "t", "pos", "h", "slots")
    k = known.select(F.col("id").alias("item_id"), F.col("t").alias("item_t"), "kind", F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots"))
    total = known.groupBy(F.col("id").alias("item_id"), F.col("t").alias("item_t")).agg(F.count_distinct("pos").alias("item_windows"))
    pairs = F.explode_outer(F.arrays_zip("item_slots", "slots"))
    # slots of each alignment: one value of the item, one value of the document
    lines = (
        found.join(k, "h").withColumn("shift", F.col("pos") - F.col("item_pos"))
        .select("id", "t", "item_id", "item_t", "kind", "shift", "item_pos", pairs.alias("p"))
        .groupBy("id", "t", "item_id", "item_t", "kind", "shift")
        .agg(F.collect_set("item_pos").alias("at"), F.count_distinct("p.item_slots").alias("n"), F.count_distinct(F.when(F.col("p.item_slots").isNotNull(), F.col("p"))).alias("m"),
             F.max(F.coalesce(F.col("p.item_slots") != F.col("p.slots"), F.lit(False))).alias("reworded"))
        .where("n = m")
    )
    covered = (
        lines.groupBy("id", "t", "item_id", "item_t")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_windows"), F.max("reworded").alias("reworded"))
        .join(total, ["item_id", "item_t"])
        .where((F.col("n_windows") >= SHARE * F.col("item_windows")) | (F.col("n_windows") >= ENOUGH))
    )
    return covered.select(
        F.col("id").alias("doc_id"), "t", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "item_windows",
        (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "reworded",
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).drop("t")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t")), "left_anti").select(*docs.columns)
