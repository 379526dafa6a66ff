"""Document fingerprints from closed syncmers (DataFrame operations only).

A text is a sequence of tokens: runs of non-blank characters (at most 32 each), and single characters
of scripts written without blanks. A window of ``K`` tokens is a closed syncmer if the smallest of its
token hashes stands at its first or last place. That depends on nothing outside the window, so an edit
moves only anchors that it touches. A fingerprint is the ``KEEP`` smallest distinct 48-bit hashes of a
text's syncmers, as 12 hex digits each; likeness is the usual bottom-k estimate of the Jaccard index.

Defined results: null text counts as empty; the fingerprint of a text without tokens is empty, and two
empty ones are alike (1.0); a text with fewer than ``K`` tokens, or with no syncmer, is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, slim

K = 5
KEEP = 48
_SINGLE = r"\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}"
#: Latin runs come first, as the cheapest to match.
TOKEN = rf"[\\x21-\\u024F]{{1,32}}|[{_SINGLE}]|[^\\x20\\x09-\\x0D\\x21-\\u024F{_SINGLE}]{{1,32}}"
LOW_48 = 0xFFFF_FFFF_FFFF
#: Documents that one window task orders, and the most such tasks.
BUCKET, BUCKETS = 2_000, 16_384


def _hashes(text: str) -> str:
    return f"transform(regexp_extract_all(coalesce({text}, ''), '{TOKEN}', 0), x -> xxhash64(x))"


def _each_syncmer(value: str, k: int) -> str:
    """SQL for an array over the windows of ``h`` that are syncmers; in ``value``, i is the window's place and x its first hash."""
    first = " and ".join(f"x <= get(h, i + {j})" for j in range(1, k))
    last = " and ".join(f"get(h, i + {k - 1}) <= get(h, i + {j})" for j in range(1, k - 1))
    return f"array_compact(transform(h, (x, i) -> if(({first}) or (get(h, i + {k - 1}) <= x and {last}), {value}, null)))"


def _window_hash(k: int) -> str:
    return f"xxhash64(x, {', '.join(f'get(h, i + {j})' for j in range(1, k))}) & {LOW_48}L"


def _or_whole(text: str, value: str, whole: str, k: int) -> str:
    """SQL for ``value`` of each syncmer; of a text with tokens but no syncmer, an array of ``whole``."""
    return let(_hashes(text), "h", let(_each_syncmer(value, k), "s", f"if(size(s) = 0 and size(h) > 0, array({whole}), s)"))


def anchors(text: str, k: int = K) -> Column:
    """Array of (pos, hash) of the text's syncmers, in order: anchors for positional matching."""
    hashed = f"struct(i as pos, {_window_hash(k)} as hash)"
    return F.expr(_or_whole(text, hashed, f"struct(0 as pos, xxhash64(h) & {LOW_48}L as hash)", k))


def sketch(text: str, k: int = K, keep: int = KEEP) -> Column:
    """Ascending array of the smallest distinct syncmer hashes."""
    hashed = _window_hash(k)
    found = _or_whole(text, hashed, f"xxhash64(h) & {LOW_48}L", k)
    return F.expr(f"slice(sort_array(array_distinct({found})), 1, {keep})")


def as_text(sketch_col: str) -> Column:
    return F.expr(f"array_join(transform({sketch_col}, x -> lower(lpad(hex(x), 12, '0'))), '')")


def likeness(a: str, b: str, keep: int = KEEP) -> Column:
    """0 to 1; 1.0 for two empty sketches."""
    union = f"slice(sort_array(array_union({a}, {b})), 1, {keep})"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect(array_intersect({union}, {a}), {b})) / greatest(size({union}), 1))")


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Each row with ``next_<c>``, the carried columns of the row that follows in descending ``key``; the last is followed by the first.

    Rows are dealt into ranges of the key between approximate quantiles, which are keys that occur.
    The largest row of a range is also sent, as a guest, to the range above it, whose last row it follows.
    """
    rows = docs.count()
    n = max(1, min(BUCKETS, -(-rows // BUCKET)))
    k = F.coalesce(F.col(key), F.lit(-(2**63))).cast("long")
    q = docs.agg(F.percentile_approx(k, [i / n for i in range(1, n)] or [0.5], 10 * n), F.max(k)).first()
    top = q[1] if q[1] is not None else 0
    bounds = sorted({b for b in (q[0] or []) if b < top}) if n > 1 else []
    spread = f"array({', '.join(f'{b}L' if b > -(2**63) else '-9223372036854775807L - 1L' for b in bounds)})" if bounds else "array(0L)"
    mid = "int((s.lo + s.hi) div 2)"
    bucket = f"""aggregate(sequence(1, {max(1, len(bounds).bit_length())}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, _) ->
        if(s.lo >= s.hi, s, if(b[{mid}] < _k, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))).lo"""
    places = let(spread, "b", f"""filter(array(
        named_struct('bucket', {bucket}, 'guest', 0),
        if({'array_contains(b, _k)' if bounds else 'false'}, named_struct('bucket', {bucket} + 1, 'guest', 1), null),
        if(_k = {top if top > -(2**63) else '-9223372036854775807L - 1'}, named_struct('bucket', 0, 'guest', 1), null)), x -> x is not null)""")
    w = Window.partitionBy("_p.bucket").orderBy("_p.guest", F.col("_k").desc(), *carried)
    return (
        docs.withColumn("_k", k).withColumn("_p", F.explode(F.expr(places)))
        .withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
        .where("_p.guest = 0").drop("_k", "_p")
    )


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likenesses.

    The edited form has the last half of the characters replaced by as many from the start of the next
    document in descending doc_id (the first after the last).
    """
    d = slim(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("fp", sketch("text"))
    n = F.char_length("text")
    edited = F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next_text, int(n_chars div 2)))")
    return (
        with_next(d, "doc_id", ["text", "fp"])
        .withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
        .select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", sketch("edited").alias("edited_fp"))
        .select(
            "doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
            likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        )
    )
