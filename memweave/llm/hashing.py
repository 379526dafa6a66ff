"""Hashes of spans of bytes or of numbers, all spans of an array at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

R = np.uint64(0x9E37_79B9_7F4A_7C15 | 1)
_INVERSE = np.uint64(pow(int(R), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers_of_two_at_least(x: np.ndarray) -> np.ndarray:
    return np.int64(1) << np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of ``values`` (uint64), by its contents alone."""
    room = 1 << max(10, (len(values) + 1).bit_length())  # few sizes, so that the powers are kept
    powers, inverse = _powers(int(R), room), _powers(int(_INVERSE), room)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * powers[: len(values)], dtype=np.uint64)))
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


#: Where words are, the masks of so many bytes of eight, and what hashes of so many bytes begin with.
_IN_WORD = bytes(b not in (10, 32) for b in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LENGTHS = mix(np.arange(256, dtype=np.uint64) * R)


def _byte_hashes(data: bytes, at: int, to: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of the bytes from ``at`` to ``to``, by its contents alone, eight bytes at a time."""
    eights = np.ndarray(to - at, "<u8", data[at:to] + bytes(8), strides=(1,))  # the eight bytes from each place on
    length = end - begin
    start = _LENGTHS[length] if length.max(initial=0) < len(_LENGTHS) else mix(length.astype(np.uint64) * R)
    out = mix(start * R + (eights[begin] & _MASKS[np.minimum(length, 8)]))
    some, done = np.flatnonzero(length > 8), 8
    while len(some):
        out[some] = mix(out[some] * R + (eights[begin[some] + done] & _MASKS[np.minimum(length[some] - done, 8)]))
        done += 8
        some = some[length[some] > done]
    return out


def word_hashes(data: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of each word between blanks and line feeds, about ``most`` bytes at a time."""
    found, at, line = [], 0, 0
    while at < len(data):
        to = len(data)
        if to - at > 2 * most:
            ends = [e for e in (data.find(b" ", at + most), data.find(b"\n", at + most)) if e >= 0]
            to = min(ends) + 1 if ends else to
        part = np.frombuffer(data, np.uint8, to - at, at)
        within = np.frombuffer(b"\0" + data[at:to].translate(_IN_WORD) + b"\0", np.uint8)
        edges = np.flatnonzero(within[1:] != within[:-1])
        begin, end = edges[::2], edges[1::2]
        feeds = np.flatnonzero(part == 10)
        found.append((_byte_hashes(data, at, to, begin, end), line + np.repeat(np.arange(len(feeds) + 1), np.diff(np.searchsorted(begin, feeds), prepend=0, append=len(begin)))))
        line += len(feeds)
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([x for _, x in found])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Take the links (a, b) into ``label``, which names for each node the least one that it is linked to so far."""
    while True:
        x, y = label[a], label[b]
        new = x != y
        if not new.any():
            return
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up
