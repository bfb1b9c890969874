"""Compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that shrinks far more than prose of its length repeats itself; one that hardly shrinks
is noise or encoded data.  Short texts shrink less, so both limits depend on the length.
Texts of a chunk or more are also cut into fixed chunks, a tail under half a chunk staying with
the chunk before it: where more than ``chunk_share`` of the bytes lie in chunks outside the
limits, the readable rest does not save the text.  The upper limits under 300 bytes lie
between prose and noise (random bytes, base64) as measured at level 3; under 80 bytes the
coder leaves most texts as they are, so ratios tell nothing there.  One pass, no shuffle; state is one text.

Defined results: null or empty text has zero counts and ratio null, and fails (fewer than
ten words); every input row gives one row, repeated rows included; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .near_dup import _P, _mix, words_memo

_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(bytes from, lowest, highest ratio): the last band that starts at or below a text's length holds."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.50, 9.0),
        (80, 0.50, 1.08),
        (100, 0.40, 1.02),
        (125, 0.40, 0.96),
        (150, 0.40, 0.92),
        (200, 0.40, 0.88),
        (300, 0.30, 0.80),
        (600, 0.30, 0.72),
        (1000, 0.25, 0.75),
        (3000, 0.22, 0.70),
        (10_000, 0.20, 0.70),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.58)
    chunk_share: float = 0.1
    level: int = 3


def repeat_words(words: list[bytes], memo: C.Memo, width: int = 5) -> int:
    """Words that lie in a window of *width* words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    s = h[: n - width + 1] * _P[0]
    for i in range(1, width):
        s = s + h[i : n - width + 1 + i] * _P[i]
    _, where, counts = np.unique(_mix(s), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def in_bands(text: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float | None, float | None, bool]:
    """Ratio of the whole, share of chunk bytes outside the chunk limits, verdict."""
    if not text:
        return None, None, False
    ratio = len(z.compress(text)) / len(text)
    low, high = next((lo, hi) for at, lo, hi in reversed(bands.whole) if len(text) >= at)
    odd, seen = 0, 0
    if len(text) >= bands.chunk_bytes:
        cut = [*range(0, len(text), bands.chunk_bytes), len(text)]
        if len(cut) > 2 and 2 * (cut[-1] - cut[-2]) < bands.chunk_bytes:
            del cut[-2]
        for lo, hi in zip(cut, cut[1:], strict=False):
            r = len(z.compress(text[lo:hi])) / (hi - lo)
            seen += hi - lo
            odd += 0 if bands.chunk[0] <= r <= bands.chunk[1] else hi - lo
    share = odd / seen if seen else None
    return ratio, share, low <= ratio <= high and (share is None or share <= bands.chunk_share)


def _judge(bands: Bands):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, z = words_memo(), zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            rows = []
            for t in C.text_bytes(b.column(1)):
                words = t.split()
                n = len(words)
                chars = len(t.translate(None, _SPACE).translate(None, _CONTINUED))
                lines = [x for x in t.split(b"\n") if x.strip()]
                again = repeat_words(words, memo)
                failed = n < 10 or 100 * again > 20 * n
                ratio, share, fine = in_bands(t, bands, z)
                rows.append((n, chars, len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), again, failed, fine and not failed, ratio, share))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *_COLUMNS])

    return run


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_chunk_share")
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunk_share double"


def quality(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Counts, ratios and verdict for every row of *docs* (doc_id, text)."""
    return C.docs_of(docs).mapInArrow(_judge(bands or Bands()), _SCHEMA)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.table(spark, sf_dir, "documents"))
