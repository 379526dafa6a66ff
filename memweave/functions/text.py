"""Text normalisation, content hashes and slices by UTF-16 offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript's trim strips, white space, line ends and the byte order mark.
JS_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(JS_SPACE))


def norm_text(c: Column | str) -> Column:
    return F.lower(js_trim(c))


def content_hash(c: Column | str) -> Column:
    """Hex SHA-256 of the trimmed, lower-cased text: what makes two claims the same."""
    return F.sha2(norm_text(c).cast("binary"), 256)


def present(c: Column | str) -> Column:
    """Truthy as a JavaScript string: neither null nor empty; white space counts."""
    return F.coalesce(F.length(_col(c)) > 0, F.lit(False))


def utf16_slice(c: Column | str, start: Column | str, end: Column | str) -> Column:
    """Characters start (inclusive, from 0) to end, counted in UTF-16 code units."""
    s, e = _col(start), _col(end)
    return F.decode(F.substring(F.encode(_col(c), "UTF-16BE"), 2 * s + 1, F.greatest(2 * (e - s), F.lit(0))), "UTF-16BE")
