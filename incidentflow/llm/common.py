"""Shared helpers: Arrow text buffers, vectorised word scanning, scratch tables, row keys."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROW = "_llm_row"           # row key used between the passes of one operator
SLICE_BYTES = 4 << 20      # text handled at once inside a task (a longer text is taken alone)


class Scratch:
    """Intermediate tables under the shared checkpoint folder (lineage cut, survive lost executors)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, work_path(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back; the shuffle files of the job are removed when it ends."""
        path, old = f"{self.base}/{name}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later pass reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
            p.getFileSystem(conf).delete(p, True)


def with_row_key(df: DataFrame, name: str = ROW) -> DataFrame:
    """Add a row key that is unique also for repeated ids and rows.

    It is the position (partition, row) in the scan, so it is the same in every pass and in a
    recomputed task as long as ``df`` is a deterministic plan over stored files.
    """
    if name in df.columns:
        raise ValueError(f"column {name} is reserved")
    return df.withColumn(name, F.monotonically_increasing_id())


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names; other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets into them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type not in (pa.string(), pa.binary()):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("" if col.type == pa.string() else b"", col.type))
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if bufs[2] is None else np.frombuffer(bufs[2], np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Row ranges of a batch of at most ``most`` text bytes each; no text is cut."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def kept(make, *files: str):
    """``make(*files)``, kept for the later tasks of a Python worker (loading a tokenizer file takes long, and two
    loaded at once take much memory). A changed file is loaded again; only the last object of a kind is kept.

    Code travels by value, so a module of this package lives as long as a task; the objects lie in one of the worker's.
    """
    store = sys.modules.setdefault("_incidentflow_kept", types.ModuleType("_incidentflow_kept")).__dict__
    kind, state = f"{make.__module__}.{make.__qualname__}", [(f, os.stat(f).st_mtime_ns, os.stat(f).st_size) for f in files]
    if store.get(kind, (None,))[0] != state:
        store.pop(kind, None)
        store[kind] = state, make(*files)
    return store[kind][1]


def released(make) -> None:
    """Forgets what ``kept`` holds of this kind in a worker."""
    store = sys.modules.get("_incidentflow_kept")
    if store is not None:
        store.__dict__.pop(f"{make.__module__}.{make.__qualname__}", None)


def _word_tables(word) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return np.array([bool(word(int(lower[b]))) for b in range(256)]), lower


#: words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z
SPACED = _word_tables(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = _word_tables(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _MULT, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def scan_words(data: np.ndarray, off: np.ndarray, tables, hashes: bool = True):
    """Words of every row: (first word of each row, starts, ends, 64-bit hash of each word).

    ``first`` has one entry more than there are rows. Positions are byte offsets into ``data``.
    """
    word, lower = tables
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return np.zeros(len(off), np.int64), z, z, np.empty(0, np.uint64)
    isw = word[data]
    edge = off[(off > 0) & (off < n)]
    new = isw.copy()
    new[1:] &= ~isw[:-1]
    new[edge] = isw[edge]
    last = isw.copy()
    last[:-1] &= ~isw[1:]
    last[edge - 1] = isw[edge - 1]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    first = np.searchsorted(start, off)
    if not hashes:
        return first, start, end, None
    size = end - start
    if len(size) == 0:
        return first, start, end, np.empty(0, np.uint64)
    at = np.cumsum(size) - size
    value = _BYTE[lower[data[isw]]]
    value *= powers(int(size.max()))[np.arange(len(value)) - np.repeat(at, size)]
    return first, start, end, mix(np.add.reduceat(value, at) + size.astype(np.uint64))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (len(h) - k + 1 values)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    p = powers(k)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i:len(h) - k + 1 + i] * p[i]
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + count)."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def binary_column(values: list) -> pa.Array:
    return pa.array(values, pa.binary())
