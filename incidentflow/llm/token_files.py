"""Operator 8 - token ids in binary files, coded by Simple-8b, in ascending document order.

Rows are dealt by ranges of (doc id, hash of the text), so equal ids spread as well, and sorted;
each task encodes its texts and writes its shard. A shard is a Parquet file whose rows are
chunks of whole documents (about ``chunk`` ids; a longer document is a chunk of its own):
shard, chunk, first (ids of the shard before it), doc_ids, doc_tokens, block (ids per
block), offsets (first word of each block), words (Simple-8b, little-endian 64-bit) and escapes.
Spark's commit protocol writes the files, so a lost executor leaves no half shard.

``read_tokens`` decodes the files; a document's start is its place in the shard plus the totals of
the shards before (one row per shard).

Cases: null or empty text: the end id alone. Null ids come first; rows of equal ids are ordered by
a hash of their text, so identical rows are interchangeable. Texts of any length;
an empty table writes no chunk; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .bpe import WORD_BPE, Encoder, encode_rows, vocabulary_path
from .common import id_text, kept, slices

CHUNK = 1 << 16


def _chunk(ids: np.ndarray, names: list, lengths: list, shard: int, chunk: int, first: int, block: int, kind):
    words, offsets, escapes = simple8b.encode(ids, block)
    one = lambda v, t: pa.array([v], t)
    return pa.RecordBatch.from_arrays(
        [one(shard, pa.int32()), one(chunk, pa.int64()), one(first, pa.int64()), one(names, pa.list_(kind)),
         one(lengths, pa.list_(pa.int64())), one(block, pa.int32()), one(offsets.tolist(), pa.list_(pa.int32())),
         one(words.astype("<u8").tobytes(), pa.binary()), one(escapes.astype("<u8").tobytes(), pa.binary())],
        names=["shard", "chunk", "first", "doc_ids", "doc_tokens", "block", "offsets", "words", "escapes"])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = WORD_BPE, end_id: int = 2, chunk: int = CHUNK,
                 block: int = simple8b.BLOCK, shards: int | None = None) -> None:
    """Write the token files of ``docs`` to the folder ``path``."""
    src = id_text(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc, shard = kept(Encoder, vocabulary_path(tokenizer)), TaskContext.get().partitionId()
        number, first, held, names, lengths, size, t = 0, 0, [], [], [], 0, None

        for whole in batches:
            t = whole.schema.field("id").type
            for b in slices(whole):
                ids, off = encode_rows(enc, b.column("text"), end_id)
                own = b.column("id").to_pylist()
                lo = 0                                    # first row of the slice not yet written
                while lo < len(own):
                    room = off[lo] + max(chunk - size, 1)
                    hi = max(lo + 1, int(np.searchsorted(off, room, side="right")) - 1)
                    if off[hi] - off[lo] + size > chunk and size:
                        hi = lo                           # the next document starts a new chunk
                    held.append(ids[off[lo]:off[hi]])
                    names += own[lo:hi]
                    lengths += np.diff(off[lo:hi + 1]).tolist()
                    size += int(off[hi] - off[lo])
                    if hi < len(own):
                        yield _chunk(np.concatenate(held), names, lengths, shard, number, first, block, t)
                        number, first = number + 1, first + size
                        held, names, lengths, size = [], [], [], 0
                    lo = hi
        if names:
            yield _chunk(np.concatenate(held), names, lengths, shard, number, first, block, t)

    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    dealt = src.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("id").asc_nulls_first(), tie)
    dealt.mapInArrow(run, f"shard int, chunk long, first long, doc_ids array<{kind}>, doc_tokens array<long>, "
                          "block int, offsets array<int>, words binary, escapes binary"
                     ).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                name, n = row.column("doc_ids")[0].values, np.asarray(row.column("doc_tokens")[0].values, np.int64)
                off = np.concatenate([[0], np.cumsum(n)])
                raw = lambda c: np.frombuffer(row.column(c)[0].as_py(), "<u8")  # noqa: E731,B023
                ids = simple8b.decode(raw("words"), np.asarray(row.column("offsets")[0].values, np.int64),
                                      raw("escapes"), int(off[-1]), row.column("block")[0].as_py()).astype("<u4")
                shard, first = row.column("shard")[0].as_py(), row.column("first")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(n), pa.int32()), name, pa.array(first + off[:-1]), pa.array(n),
                     pa.array([ids[lo:hi].tobytes() for lo, hi in zip(off[:-1], off[1:])], pa.binary())],
                    names=["shard", "id", "place", "n_tokens", "ids"])

    rows = files.mapInArrow(run, f"shard int, id {kind}, place long, n_tokens long, ids binary")
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x))
                                        .alias("_n"))
    before = totals.select("shard", F.coalesce(F.sum("_n").over(                # one row per shard
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "shard").select(
        F.col("id").alias(id_col), (F.col("place") + F.col("_before")).alias("start"), "n_tokens", "ids")
