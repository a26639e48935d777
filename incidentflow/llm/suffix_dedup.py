"""Operator 5 - removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``width`` bytes over it also starts anywhere else (another document or
the same one). Windows are brought together by content: equal windows have equal anchors
(anchors.py), so

1. every document gives one row per run of windows with one anchor: hash of the anchor, hash of
   the run's bytes, place; no text;
2. anchors seen once are dropped; if all runs of an anchor are equal, all their windows repeat;
3. of the other runs one copy each of equal ones fetches its bytes; copies of an anchor meet in a
   task, which sorts their suffixes (two-stage sorting), computes adjacent common prefixes and
   marks the windows that occur twice (counting the copies). An anchor with more than ``hot`` different runs
   is salted; its windows that are single in their part meet once more by digest;
4. marked windows go back to all copies and to their documents, and overlapping spans are joined.

Cases: null text: empty. Texts shorter than ``width`` lose nothing. Repeated rows and ids are
separate documents (so a repeated long text is removed whole). Texts of any length; an
empty table gives an empty result. All columns are kept; the result is one struct column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import runs
from .common import ROW, Scratch, mix, powers, slices, text_buffer, with_row_key
from .suffix_sort import Suffixes

WIDTH = 200
HOT = 8192                     # different runs of one anchor in one sort
CHUNK = 2 << 20                # bytes sorted at once (whole groups)
PASS = 1 << 19                 # text bytes whose anchors are found at once
ROWS = 1 << 14                 # windows of salted anchors sent to Spark at once
SPAN = "array<struct<lo: bigint, hi: bigint>>"
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_FACTOR, -1, 1 << 64))


def _run_rows(text: DataFrame, width: int) -> DataFrame:
    def run(batches):
        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for whole in batches:
            for b in slices(whole, most=PASS):
                data, off = text_buffer(b.column("text"))
                row, start, n, h = runs(data, off, width)
                if not len(row):
                    continue
                p = powers(len(data))
                total = np.concatenate([[np.uint64(0)], np.cumsum(value[data] * p, dtype=np.uint64)])
                lo = off[row] + start
                back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE, np.uint64)]),
                                  dtype=np.uint64)
                c = mix((total[lo + n + width - 1] - total[lo]) * back[lo])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), b.column(ROW).take(pa.array(row)),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["h", "c", ROW, "start", "n"])

    return text.mapInArrow(run, f"h long, c long, {ROW} long, start int, n int")


def _cut(text: DataFrame, picked: DataFrame, width: int) -> DataFrame:
    """The bytes of the picked runs: (h, c, n, copies, salt, hot, bytes)."""
    own = picked.groupBy(ROW).agg(F.collect_list(F.struct("h", "c", "n", "copies", "salt", "hot", "start")).alias("r"))

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                data, off = text_buffer(b.column("text"))
                data, lists = data.tobytes(), b.column("r")
                r = lists.flatten()
                count = np.diff(np.asarray(lists.offsets, np.int64))
                lo = (np.repeat(off[:-1], count) + np.asarray(r.field("start"), np.int64)).tolist()
                got = [data[a:a + k + width - 1] for a, k in zip(lo, r.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(r.field(x) for x in ("h", "c", "n", "copies", "salt", "hot")), pa.array(got, pa.binary())],
                    names=["h", "c", "n", "copies", "salt", "hot", "bytes"])

    return text.join(own, ROW).select("text", "r").mapInArrow(
        run, "h long, c long, n int, copies long, salt int, hot boolean, bytes binary")


def _marked(cut: DataFrame, width: int, chunk: int) -> DataFrame:
    """Repeated windows of the cut runs: (h, c, n, lo, hi, digest, single). Windows [lo, hi) repeat
    where digest is null; else one row for each window of a salted anchor, still to be compared."""
    names = ["h", "c", "n", "lo", "hi", "digest", "single"]

    def solve(h, c, n, copies, hot, text):
        h, c, n = (np.array(x, k) for x, k in ((h, np.int64), (c, np.int64), (n, np.int32)))
        size = np.array([len(x) for x in text])
        begin = np.cumsum(size) - size
        t = np.frombuffer(b"".join(text), np.uint8)
        valid = np.zeros(len(t) + 1, np.int64)
        np.add.at(valid, begin, 1)
        np.add.at(valid, begin + n, -1)
        place, kind = Suffixes(t, width).equal_runs(np.cumsum(valid[:-1]) > 0)
        own = np.searchsorted(begin, place, side="right") - 1
        weight = np.bincount(kind, np.array(copies, np.float64)[own])
        twice = np.zeros(len(t) + 1, bool)
        twice[place] = weight[kind] >= 2
        which, edges = [], []
        for i in np.unique(own[weight[kind] >= 2]).tolist():
            d = np.concatenate([[False], twice[begin[i]:begin[i] + n[i]], [False]])
            edge = np.flatnonzero(d[1:] != d[:-1]).reshape(-1, 2)
            which.append(np.full(len(edge), i))
            edges.append(edge)
        if which:
            o, edge = np.concatenate(which), np.concatenate(edges)
            yield batch(h[o], c[o], n[o], edge[:, 0], edge[:, 1])
        part = np.array(hot)
        if part.any():
            # all single windows, and one of each class of equal ones for the other parts to find
            single = weight[kind] < 2
            wait = np.flatnonzero(part[own] & (single | np.append(True, kind[1:] != kind[:-1])[:len(kind)]))
            for at in range(0, len(wait), ROWS):               # a salted anchor has a row for nearly every byte
                w = wait[at:at + ROWS]
                p, o = place[w], own[w]
                digest = [hashlib.blake2b(t[x:x + width], digest_size=16).digest() for x in p.tolist()]
                lo = p - begin[o]
                yield batch(h[o], c[o], n[o], lo, lo + 1, digest, single[w])

    def batch(h, c, n, lo, hi, digest=None, single=None):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), k) if x is None else pa.array(x, k) for x, k in zip(
            (h, c, n, lo.astype(np.int32), hi.astype(np.int32), digest, single), types)], names=names)

    def run(batches):
        held, size, last = [[] for _ in range(6)], 0, None
        for b in batches:
            for h, c, n, copies, salt, hot, x in zip(*(b.column(k).to_pylist() for k in (
                    "h", "c", "n", "copies", "salt", "hot", "bytes"))):
                if size >= chunk and (h, salt) != last:
                    yield from solve(*held)
                    held, size = [[] for _ in range(6)], 0
                for k, v in zip(held, (h, c, n, copies, hot, x)):
                    k.append(v)
                size, last = size + len(x), (h, salt)
        if size:
            yield from solve(*held)

    return (cut.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(
        run, "h long, c long, n int, lo int, hi int, digest binary, single boolean"))


def repeated_spans(text: DataFrame, scratch: Scratch, width: int = WIDTH, hot: int = HOT,
                   chunk: int = CHUNK) -> DataFrame:
    """(row key, spans) of every row with repeated strings; spans [lo, hi) in bytes may overlap."""
    every = scratch.save(_run_rows(text, width), "runs")
    anchors = every.groupBy("h").agg(F.count("*").alias("total"), F.min(F.struct("c", "n")).alias("a"),
                                     F.max(F.struct("c", "n")).alias("b"))
    anchors = anchors.filter("total > 1").select("h", (F.col("a") == F.col("b")).alias("alike"))
    found = scratch.save(every.join(anchors, "h"), "found")
    scratch.drop("runs")
    kinds = found.filter("not alike").groupBy("h", "c", "n").agg(
        F.count("*").alias("copies"), F.min(F.struct(ROW, "start")).alias("one"))
    kinds = scratch.save(kinds.select("h", "c", "n", "copies", "one.*"), "kinds")
    parts = (kinds.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > hot)
             .select("h", F.ceil(F.col("k") / hot).cast("int").alias("parts")))
    picked = kinds.join(parts, "h", "left").select(
        "h", "c", "n", "copies", ROW, "start",
        F.pmod(F.xxhash64("c", "n"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"),
        F.col("parts").isNotNull().alias("hot"))
    marked = scratch.save(_marked(_cut(text, picked, width), width, chunk), "marked")
    scratch.drop("kinds")
    wait = marked.filter("digest is not null")
    twice = wait.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest")
    again = wait.filter("single").join(twice, "digest", "left_semi")
    lists = (marked.filter("digest is null").select("h", "c", "n", "lo", "hi")
             .unionByName(again.select("h", "c", "n", "lo", "hi")))
    spans = found.filter("not alike").join(lists, ["h", "c", "n"]).select(
        ROW, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + (width - 1)).alias("hi"))
    plain = found.filter("alike").select(ROW, F.col("start").alias("lo"),
                                         (F.col("start") + F.col("n") + (width - 1)).alias("hi"))
    return spans.unionByName(plain).groupBy(ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))


def suffix_dedup(docs: DataFrame, text_col: str = "text", width: int = WIDTH, into: str = "dedup",
                 hot: int = HOT, chunk: int = CHUNK, as_text: bool = False) -> DataFrame:
    """``docs`` with a struct column: n_bytes, n_removed, spans (removed runs, [lo, hi) in bytes), kept
    (the remaining bytes; ``as_text``: as a string, without characters of which a part was removed)."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    spark, keyed = docs.sparkSession, with_row_key(docs)
    scratch = Scratch(spark, "suffix")
    text = keyed.select(ROW, F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = scratch.save(repeated_spans(text, scratch, width, hot, chunk), "spans")
    scratch.drop("found", "marked")
    joined = keyed.join(spans, ROW, "left").drop(ROW)
    result = T._parse_datatype_string(f"struct<n_bytes: bigint, n_removed: bigint, spans: {SPAN}, "
                                      f"kept: {'string' if as_text else 'binary'}>")
    schema = T.StructType(docs.schema.fields + [T.StructField(into, result)])

    def run(batches):
        def kept(x):
            return x.tobytes().decode("utf-8", "ignore") if as_text else x.tobytes()

        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span),
                          ("kept", pa.string() if as_text else pa.binary())])
        for whole in batches:
            for b in slices(whole, text_col):
                data, off = text_buffer(b.column(text_col))
                out = []
                for i, own in enumerate(b.column("_spans")):
                    x = data[off[i]:off[i + 1]]
                    if own.is_valid and len(own):
                        r = own.values
                        lo, hi = np.asarray(r.field("lo"), np.int64), np.asarray(r.field("hi"), np.int64)
                        gone = np.zeros(len(x) + 2, np.int64)
                        np.add.at(gone, lo, 1)
                        np.add.at(gone, hi, -1)
                        gone = np.cumsum(gone[:-1]) > 0            # the last entry is False
                        edge = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
                        out.append({"n_bytes": len(x), "n_removed": int(gone.sum()),
                                    "spans": [{"lo": int(s), "hi": int(e)} for s, e in edge],
                                    "kept": kept(x[~gone[:-1]])})
                    else:
                        out.append({"n_bytes": len(x), "n_removed": 0, "spans": [], "kept": kept(x)})
                cols = [b.column(c) for c in b.schema.names if c != "_spans"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, kind)],
                                                 names=[*(c for c in b.schema.names if c != "_spans"), into])

    return joined.mapInArrow(run, schema)
