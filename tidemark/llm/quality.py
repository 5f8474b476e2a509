"""Operator 1: quality rules, with compression bands as the method's verdict."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, map_text, words

SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """Limits on bytes / zstandard-compressed bytes, by the length of what is compressed.

    `most` and `least` are (bytes, ratio) corners, joined by lines over the logarithm of the length
    and level outside: short texts compress less, so their limits lie lower. Past its last corner
    `most` goes on rising as between its last two, as whole ratios do with length. A ratio above it
    means repetition (boilerplate, symbol runs), one below `least` text without a language's
    redundancy (keys, encoded bytes). A document fails by its whole ratio, or if over `bad_share`
    of its chunks lie outside. The corners were set from rows with a quality label: about 0.05 above
    the largest ratio of good documents of each length.
    """

    level: int = 3
    chunk_bytes: int = 4096
    bad_share: float = 0.5
    most: tuple[tuple[int, float], ...] = (
        (256, 2.0), (512, 2.05), (1024, 2.12), (2048, 2.22), (4096, 2.33), (8192, 2.46), (16384, 2.53), (32768, 2.61), (65536, 2.7),
    )
    least: tuple[tuple[int, float], ...] = ((255, 0.0), (256, 1.15), (512, 1.25), (1024, 1.4), (4096, 1.6), (16384, 1.7))

    def outside(self, ratio: float, size: int) -> bool:
        (a, low), (b, high) = self.most[-2:]
        beyond = max(0.0, np.log2(max(1, size) / b)) * (high - low) / np.log2(b / a)
        return not _at(self.least, size) <= ratio <= _at(self.most, size) + beyond


def _at(corners: tuple[tuple[int, float], ...], size: int) -> float:
    return float(np.interp(np.log2(max(1, size)), [np.log2(x) for x, _ in corners], [y for _, y in corners]))


def repeated_words(ws: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(ws) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * len(number) + ids[2:]
    _, kind, count = np.unique(triple, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[kind] > 1)
    inside = np.zeros(len(ws), bool)
    for k in range(3):
        inside[starts + k] = True
    return int(inside.sum())


def measure(text: str, bands: Bands, compress) -> tuple:
    ws = words(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    repeat = repeated_words(ws)
    failed = len(ws) < 50 or 100 * repeat > 50 * len(ws)
    raw = text.encode()
    ratio = len(raw) / len(compress(raw)) if raw else 0.0
    chunks = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)]
    if len(chunks) > 1 and len(chunks[-1]) < bands.chunk_bytes // 2:  # too short a rest says nothing
        chunks.pop()
    bad = sum(bands.outside(len(c) / len(compress(c)), len(c)) for c in chunks)
    kept = not failed and not bands.outside(ratio, len(raw)) and bad <= bands.bad_share * len(chunks)
    return (
        len(ws), len(text) - sum(map(text.count, " \t\n\v\f\r")), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        repeat, failed, kept, ratio, len(chunks), bad,
    )


FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("ratio", T.DoubleType()), ("n_chunks", T.LongType()), ("n_bad_chunks", T.LongType()),
]


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and the measures of FIELDS for every document.

    Null and empty texts have no words: all counts are 0, ratio 0.0, base_failed true, kept false.
    Nulls in doc_id and repeated rows stay as they are; other columns are dropped.
    """

    def compute(texts: list[str]) -> dict[str, object]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        rows = [measure(x, bands, compress) for x in texts]
        return {n: [r[i] for r in rows] for i, (n, _) in enumerate(FIELDS)}

    return map_text(docs, compute, FIELDS)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged; one narrow map, no join."""

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            kept = [measure(x or "", bands, compress)[6] for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
