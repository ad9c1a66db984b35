"""Quality rules: word statistics and compression bands.

The zstandard ratio (compressed bytes over bytes) is taken over the whole text and over its fixed chunks. Repetitive text
compresses far below ordinary text and random or encoded text far above it; what is ordinary depends on the length, so
each band of lengths has its own limits. A text is rejected when its whole ratio leaves its band or when more than
`MAX_BAD_CHUNKS` of its chunks do; what follows the last full chunk is a chunk too, held to the band of its own length.
`n_chunks` counts the full chunks, `n_bad_chunks` all that leave their limits.

Words are runs of anything but the six ASCII white-space characters, which is what ``bytes.split()`` gives.

Defined cases: a null text is an empty one, with no words, zeros everywhere, ratio null and kept false; a text without a
full chunk is judged by its whole ratio alone. One result row per input row, so repeated rows stay; null ids stay null;
other columns are ignored. Each row is worked by itself: no shuffle, memory of one batch plus one text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from footreach.llm.batches import small_batches

#: (bytes below which the limits hold, least ratio, greatest ratio); the last one is open.
BANDS = ((64, 0.0, float("inf")), (128, 0.30, 1.25), (256, 0.22, 1.05), (1024, 0.18, 0.90), (4096, 0.15, 0.78), (1 << 62, 0.10, 0.72))
CHUNK_BYTES, CHUNK_LIMITS, MAX_BAD_CHUNKS, LEVEL = 4096, (0.12, 0.78), 0.25, 3
_SPACE_AND_TAILS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, zstd_ratio double, n_chunks bigint, n_bad_chunks bigint")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five consecutive words that occur at least twice."""
    n = len(words)
    if n < 6:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, n)
    mixed = (ids + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    m = n - 4
    key = mixed[:m].copy()
    for k in range(1, 5):
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key += mixed[k:m + k]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    windows = [tuple(ids[p:p + 5].tolist()) for p in at.tolist()]  # equal keys are checked word by word
    seen = Counter(windows)
    step = np.zeros(n + 1, np.int64)
    for p, w in zip(at.tolist(), windows):
        if seen[w] > 1:
            step[p] += 1
            step[p + 5] -= 1
    return int((np.cumsum(step)[:n] > 0).sum())


def text_stats(b: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x and not x.isspace()] if b"\n" in b else []
    return (len(words), len(b.translate(None, _SPACE_AND_TAILS)), len(b) - len(b.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def limits(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in BANDS if n_bytes < below)


def compression(b: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Whole ratio, full chunks, chunks outside their limits (the tail included), and whether the text is within its bands."""
    if not b:
        return None, 0, 0, False
    ratio = len(zip_.compress(b)) / len(b)
    low, high = limits(len(b))
    n, tail = divmod(len(b), CHUNK_BYTES)
    bad = 0
    view = memoryview(b)
    for k in range(n):
        r = len(zip_.compress(view[k * CHUNK_BYTES:(k + 1) * CHUNK_BYTES])) / CHUNK_BYTES
        bad += not CHUNK_LIMITS[0] <= r <= CHUNK_LIMITS[1]
    if n and tail:
        least, most = limits(tail)
        bad += not least <= len(zip_.compress(view[n * CHUNK_BYTES:])) / tail <= most
    return ratio, n, bad, low <= ratio <= high and bad <= MAX_BAD_CHUNKS * (n + (n > 0 and tail > 0))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    for ids, texts in small_batches(batches):
        rows = []
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            n_words, *rest, repeats = text_stats(b)
            failed = n_words < 10 or 100 * repeats > 20 * n_words
            ratio, n, bad, fine = compression(b, zip_)
            rows.append((n_words, *rest, repeats, failed, fine and not failed, ratio, n, bad))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(_judge, SCHEMA)


def op1(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
