"""Whole-text work on Arrow batches: bounded chunks, word spans and span hashes, all in numpy.

Texts are handled as UTF-8 bytes. A word class of the contracts either treats every byte of a
multi-byte character as a word byte or as none, so byte spans are word spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch; with texts of a few kB this is a few MB for each Python worker.
BATCH_ROWS = 1024
#: Bytes of text whose numpy arrays are held at once (about 60 bytes of arrays for each).
CHUNK_BYTES = 1 << 20

_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows in an Arrow batch, which long texts overfill; a lower setting stays."""
    if int(spark.conf.get(_CONF, "10000")) > BATCH_ROWS or int(spark.conf.get(_CONF, "10000")) <= 0:
        spark.conf.set(_CONF, str(BATCH_ROWS))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that extra or clashing columns of the caller can't interfere."""
    return df.select(*[df[name].alias(alias) for alias, name in columns.items()])


@dataclass
class Chunk:
    """Some rows of a batch: their row range, their bytes end to end, and len(rows) + 1 byte offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch into row ranges of at most ``limit`` bytes; a longer text is a chunk of its own. Null is empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: whether the byte is in one of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(chunk: Chunk, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes for which ``member`` holds; a run never crosses rows."""
    inside = member[chunk.data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    firsts = chunk.offsets[:-1][chunk.offsets[:-1] < chunk.offsets[1:]]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[firsts] = inside[firsts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = chunk.offsets[1:][chunk.offsets[:-1] < chunk.offsets[1:]] - 1
    end[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(chunk.offsets, starts, side="right") - 1


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of ``values`` (bytes, or hashes of words) that depends on the span's content only."""
    values = _BYTE_VALUES[values] if values.dtype == np.uint8 else values
    up, down = _powers_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
