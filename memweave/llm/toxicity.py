"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary is trained on windows of ordinary documents. Toxic documents are mostly
ordinary text too, so the toxic dictionary is what sets them apart, put before the same ordinary
content: words and beginnings of words that recur in toxic documents in unrelated contexts and hardly ever in ordinary ones.
They are kept as whole words, and ordinary words that
look like their beginnings are known to both. Each window of a text is compressed with both, under the same parameters; the bytes saved by the toxic
dictionary are its gain. A logistic map of a document's largest gains, fitted on the labelled sample,
calibrates the threshold, and the number of segments is the one that does best on a part left out.

Defined results: null counts as empty text, which has no window and gets the score of no gain; without
labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_col
from .training import fit_logistic, labelled_sample, score_documents

FOLDS, HELD, THRESHOLD = 5, 0, 0.5
WINDOW, ORDINARY_BYTES, TRAIN_WINDOWS, TRAIN_BYTES = 32, 8_000, 20_000, 4_000_000
#: Numbers of toxic segments to choose from; their least support in texts, and as a share of toxic texts; the least ratio of shares.
SEGMENTS, SUPPORT, SPREAD, RATIO = (8, 16, 24, 40, 80, 160, 256), 4, 0.02, 4
#: Bytes of a segment.
SHORTEST, LONGEST = 4, 16
TOXIC_BYTES = 6_000
_WINDOWS = re.compile(rb".{1,%d}(?:\s|$)|.{%d}" % (WINDOW, WINDOW), re.S)
_EDGE = b".,;:!?\"'()[]{}<>%$*#&|_-=+/\\"


def windows(text: str) -> list[bytes]:
    """The whole text, lower-cased, in windows of ``WINDOW`` bytes that end at a blank where there is one."""
    return _WINDOWS.findall(text.lower().encode())


def _starts(word: bytes) -> Iterator[bytes]:
    """The word and its beginnings of ``SHORTEST`` bytes or more, whole characters each."""
    for n in range(SHORTEST, min(len(word), LONGEST) + 1):
        if n == len(word) or word[n] & 0xC0 != 0x80:
            yield word[:n]


def _words(text: str) -> list[bytes]:
    return [w for w in (w.strip(_EDGE) for w in text.lower().encode().split()) if w]


def _counts(texts: list[str], among: set[bytes] | None = None) -> Counter[bytes]:
    """In how many texts each beginning of a word occurs."""
    found: Counter[bytes] = Counter()
    for text in texts:
        own = {s for w in set(_words(text)) for s in _starts(w)}
        found.update(own if among is None else own & among)
    return found


def _support(texts: list[str], among: set[bytes]) -> dict[bytes, int]:
    """In how many unrelated contexts each occurs.

    Contexts of copies and near copies are the same or share a least hash, so a repeated document counts about once.
    """
    contexts, groups = defaultdict(set), defaultdict(lambda: (set(), set(), set()))
    for text in texts:
        words = [b"^", *_words(text), b"$"]
        pairs = np.array([xxhash.xxh64_intdigest(b" ".join(p)) for p in zip(words, words[1:], strict=False)], np.uint64)
        least = [int((pairs ^ np.uint64(m)).min()) for m in (0, 0x5BD1_E995_A1B2_C3D4, 0x2545_F491_4F6C_DD1D)]
        for a, b, c in zip(words, words[1:], words[2:], strict=False):
            for s in _starts(b):
                if s in among:
                    contexts[s].add((a, c))
                    for seen, v in zip(groups[s], least, strict=True):
                        seen.add(v)
    return {s: min(len(v), *map(len, groups[s])) for s, v in contexts.items()}


def toxic_segments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words and beginnings of words that set toxic documents apart, the most telling first; none begins another."""
    least = max(SUPPORT, SPREAD * len(toxic))
    has = {s: n for s, n in _counts(toxic).items() if n >= least}
    had = _counts(ordinary, set(has))

    def ratio(n: int, m: int) -> float:
        return (n + 0.5) / (len(toxic) + 1) / ((m + 0.5) / (len(ordinary) + 1))

    has = _support(toxic, {s for s, n in has.items() if ratio(n, had[s]) > RATIO})
    telling = {s: n * math.log(ratio(n, had[s])) for s, n in has.items() if n >= least and ratio(n, had[s]) > RATIO}
    chosen: list[bytes] = []
    for s in sorted(telling, key=lambda s: (-telling[s], -len(s), s)):
        if not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
            if len(chosen) == max(SEGMENTS):
                break
    return chosen


def ordinary_content(ordinary: list[str]) -> bytes:
    found, size = [], 0
    per = max(1, TRAIN_WINDOWS // max(1, len(ordinary)))
    for text in ordinary:
        w = windows(text)
        part = w[:: max(1, len(w) // per)]
        found += part
        size += sum(map(len, part))
        if size > TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES + 512, found, k=32, d=8).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(found)[-ORDINARY_BYTES:]


def whole_words(segments: list[bytes], toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The toxic texts' words that begin with a segment, if found in two texts and in no ordinary one; else the segment."""
    at = {s: i for i, s in enumerate(segments)}
    found: Counter[bytes] = Counter()
    for text in toxic:
        found.update({w for w in _words(text) if any(s in at for s in _starts(w))})
    found = Counter({w: n for w, n in found.items() if n >= 2})
    for text in ordinary:
        for w in found.keys() & set(_words(text)):
            del found[w]
    ranked = sorted(found, key=lambda w: (min(at[s] for s in _starts(w) if s in at), -found[w], w))
    rest = [s for s in segments if not any(w.startswith(s) for w in ranked)]
    kept, size = [], 0
    for w in ranked + rest:
        size += len(w) + 1
        if size > TOXIC_BYTES:
            break
        kept.append(w)
    return kept


def look_alikes(segments: list[bytes], ordinary: list[str]) -> list[bytes]:
    """Whole ordinary words that are the beginning of a toxic segment, as both dictionaries should know them."""
    starts = {p for s in segments for p in _starts(s) if p != s}
    found: Counter[bytes] = Counter()
    for text in ordinary:
        found.update(starts.intersection(_words(text)))
    return sorted(w for w, n in found.items() if n >= 2)


def _content(segments: list[bytes]) -> bytes:
    """Dictionary content: each segment after a blank, where it begins a word."""
    return b"".join(b" " + s for s in segments) + b" " * bool(segments)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=15, chain_log=13, hash_log=13, search_log=4, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


@lru_cache(maxsize=4)
def _pair(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(ordinary), _compressor(toxic + ordinary)


def gain_features(text: str, ordinary: bytes, toxic: bytes) -> list[float]:
    plain, other = (c.compress for c in _pair(ordinary, toxic))
    # windows end at blanks, so the blank that begins a word, as in the dictionary, goes before each
    gains = np.array([len(plain(w)) - len(other(w)) for w in (b" " + w for w in windows(text))] or [0])
    top = np.clip(-np.partition(-np.append(gains, [0, 0, 0]), 3)[:4], 0, 8)
    above = [float((gains >= g).sum()) for g in (1, 2, 4)]
    n = len(gains)
    return [float(top.max()), float(top.sum()) / 4, *(math.log1p(a) for a in above), *(a / n for a in above), math.log1p(n), float(top.max() >= 3)]


class CompressionDistance:
    def __init__(self, sample: list[tuple[str, int]], toxic_share: float):
        tox, plain = ([t for t, y in sample if y == v] for v in (1, 0))
        self.fitted = bool(tox and plain)
        if not self.fitted:
            return
        y = np.array([v for _, v in sample], float)
        # the share of toxic documents in the sample is not that of the corpus
        prior = math.log(max(1e-6, toxic_share) / max(1e-6, 1 - toxic_share)) - math.log(len(tox) / len(plain))
        part = np.arange(len(sample)) % 4 == 0
        best = None
        # the part left out teaches no dictionary either
        inner_tox, inner_plain = ([t for (t, v), p in zip(sample, part, strict=True) if v == u and not p] for u in (1, 0))
        inner = toxic_segments(inner_tox, inner_plain)
        self.trained = ordinary_content(inner_plain)
        for n in sorted({min(n, len(inner)) for n in SEGMENTS}):
            x = self._features(sample, inner[:n], inner_tox, inner_plain)
            z = x[part] @ (w := fit_logistic(x[~part], y[~part]))[:-1] + w[-1] + prior
            weight = np.where(y[part] > 0, toxic_share / max(1, (y[part] > 0).sum()), (1 - toxic_share) / max(1, (y[part] == 0).sum()))
            loss = float((weight * np.logaddexp(0, -np.where(y[part] > 0, z, -z))).sum())
            if best is None or loss < best[0] - 1e-4:
                best = (loss, n)
        self.trained = ordinary_content(plain)
        self.weights = fit_logistic(self._features(sample, toxic_segments(tox, plain)[: best[1]], tox, plain), y)
        self.weights[-1] += prior

    def _features(self, sample: list[tuple[str, int]], segments: list[bytes], toxic: list[str], plain: list[str]) -> np.ndarray:
        """Of the sample's documents, with dictionaries of these segments, which stay the model's."""
        self.ordinary, self.toxic = self.trained + _content(look_alikes(segments, plain)), _content(whole_words(segments, toxic, plain))
        return np.array([gain_features(t, self.ordinary, self.toxic) for t, _ in sample])

    def score(self, text: str) -> float:
        if not self.fitted:
            return 0.0
        z = np.dot(gain_features(text, self.ordinary, self.toxic), self.weights[:-1]) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(docs: DataFrame, labels: DataFrame) -> CompressionDistance:
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD)
    known = labels.where(F.col("toxic").isNotNull() & (fold_col("doc_id", FOLDS) != HELD))
    return CompressionDistance(sample, known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = train(docs, labels)
    scored = score_documents(docs, lambda texts: {"score": np.array([model.score(t) for t in texts], float)}, "score double")
    return scored.select("doc_id", (fold_col("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; scored in place, so that no join is needed."""
    model = train(docs, labels)

    def task(batches):
        for batch in batches:
            keep = [not t or model.score(t) < THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
