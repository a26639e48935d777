"""Operator 12 - vector code compression: four codebooks, trained and searched by equal averages.

A component x becomes the integer floor(1024 x); a vector is cut into ``PARTS`` consecutive parts and
each part is coded by the nearest entry of its position's codebook (squared Euclidean distance, ties to
the lower index). Codebooks start as the parts of the smallest ids and are moved ``rounds`` times to
the componentwise floor of the mean of their parts; an unused entry stays.

Search (equal averages): entries are sorted by component sum. For two parts of dimension w the squared gap of
their sums is at most w times their squared distance, so the search starts at the entries whose sums are
nearest the part's own and goes outward on both sides until the squared gap over w strictly
exceeds the best distance. Entries are tried in bundles of neighbours in that order, many parts at once.

A round is one pass over the table: tasks add up their own parts (one row for each used entry of a
task), Spark adds those sums; only the codebooks reach the driver (256 entries by the dimension, whatever the
table's size). Sums over labels are joined with salt, so a label may hold any share of the rows.

Cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. The dimension is
that of the smallest kept id; a kept vector of another length has no code (null) and no error (null,
nothing added). A dimension that 4 does not divide: parts as equal as can be. Fewer than 256 kept
rows: that many entries. Repeated ids and rows count each; equal ids are ordered by their vectors; null ids
come last. Null labels are one label. An empty table gives an empty result. Components must be below 2^15 in
size, so that all sums are exact in 64 bits; a larger one is an error.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .skew import join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BUNDLE = 16                    # neighbouring entries tried together
LARGEST = 1 << 15              # components must be smaller
SLICE = 8192                   # vectors handled at once in a task


class Codebook:
    """The entries of one part position, in bundles of neighbouring sums."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.width = entries, max(entries.shape[1], 1)
        total = entries.sum(axis=1)
        order = np.argsort(total, kind="stable")
        self.bundles = [np.sort(order[i:i + BUNDLE]) for i in range(0, len(order), BUNDLE)]
        self.low = np.array([total[b].min() for b in self.bundles])
        self.high = np.array([total[b].max() for b in self.bundles])
        self.most = int(np.abs(entries).max(initial=0))

    def _distances(self, x: np.ndarray, bundle: np.ndarray, real: bool) -> np.ndarray:
        e = self.entries[bundle]
        if real:                                           # every term is exact in a double
            e = e.astype(np.float64)
            return ((x * x).sum(axis=1)[:, None] + (e * e).sum(axis=1) - 2 * (x @ e.T)).astype(np.int64)
        return np.stack([((x - v) ** 2).sum(axis=1) for v in e], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row of ``x``."""
        total, n = x.sum(axis=1), len(x)
        real = 8 * self.width * max(int(np.abs(x).max(initial=0)), self.most, 1) ** 2 < 1 << 53
        point = x.astype(np.float64) if real else x
        best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)

        def attempt(rows, at):
            bundle = self.bundles[at]
            d = self._distances(point[rows], bundle, real)
            j = d.argmin(axis=1)                           # the first: bundles are in index order
            d, j = d[np.arange(len(rows)), j], bundle[j]
            better = (d < best[rows]) | ((d == best[rows]) & (j < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], j[better]

        home = np.clip(np.searchsorted(self.low, total, side="right") - 1, 0, None)
        for at in np.unique(home).tolist():
            left = right = np.flatnonzero(home == at)
            attempt(left, at)
            for step in range(1, len(self.bundles)):
                if at + step < len(self.bundles) and len(right):
                    right = right[(self.low[at + step] - total[right]) ** 2 <= self.width * best[right]]
                    attempt(right, at + step)
                if at - step >= 0 and len(left):
                    left = left[(total[left] - self.high[at - step]) ** 2 <= self.width * best[left]]
                    attempt(left, at - step)
        return index, best


def cuts(dim: int) -> list[tuple[int, int]]:
    """First and last component (exclusive) of every part."""
    return [(dim * i // PARTS, dim * (i + 1) // PARTS) for i in range(PARTS)]


def integers(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    if len(x) and np.abs(x).max(initial=0) >= LARGEST:
        raise OverflowError(f"a vector component is not below {LARGEST} in size")
    return np.floor(x * SCALE).astype(np.int64)


def _kept(batch: pa.RecordBatch, dim: int):
    """(indexes of the rows with a complete vector, their length is ``dim``, integer vectors of those)."""
    col = batch.column("vector")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(col.value_lengths().fill_null(-1), np.int64)
    flat = col.flatten()
    value = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    whole = (size >= 0) & (bad[at + np.maximum(size, 0)] == bad[at])
    rows = np.flatnonzero(whole)
    fits = size[rows] == dim
    take = at[rows[fits]][:, None] + np.arange(dim)
    return rows, fits, integers(value[take])


def _sums(vectors: DataFrame, books: list[Codebook], dim: int) -> DataFrame:
    """(part, entry, count, sums) of the parts nearest to every entry, one row for a task."""
    def run(batches):
        count = [np.zeros(len(b.entries), np.int64) for b in books]
        total = [np.zeros(b.entries.shape, np.int64) for b in books]
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                x = _kept(whole.slice(lo, SLICE), dim)[2]
                for p, (a, b) in enumerate(cuts(dim)):
                    index = books[p].nearest(x[:, a:b])[0]
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    if len(used):
                        count[p][used] += np.diff(np.append(first, len(order)))
                        total[p][used] += np.add.reduceat(x[order, a:b], first, axis=0)
        part, entry = zip(*[(p, e) for p in range(PARTS) for e in np.flatnonzero(count[p])]) if any(
            c.any() for c in count) else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
             pa.array([int(count[p][e]) for p, e in zip(part, entry)], pa.int64()),
             pa.array([total[p][e] for p, e in zip(part, entry)], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    return vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[Codebook], int]:
    """(codebooks, dimension) from a table (id, vector)."""
    whole = "vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    seeds = vectors.select("id", "vector").filter(whole).orderBy(F.col("id").asc_nulls_last(), "vector")
    first = seeds.limit(entries).collect()                 # at most ``entries`` rows
    dim = len(first[0]["vector"]) if first else 0
    if any(len(r["vector"]) != dim for r in first):
        first = seeds.filter(F.size("vector") == dim).limit(entries).collect()
    x = integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dim))
    books = [Codebook(x[:, a:b]) for a, b in cuts(dim)]
    for _ in range(rounds if first and dim else 0):
        # the codebooks' sizes bound what is collected: a row for each entry and component
        sums = (_sums(vectors, books, dim).select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
                .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
        moved = [b.entries.copy() for b in books]
        for r in sums:
            moved[r["part"]][r["entry"], r["at"]] = r["s"] // r["n"]
        books = [Codebook(m) for m in moved]
    return books, dim


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[Codebook], dim: int) -> DataFrame:
    """(id, label, code, error) of every kept row of (id, label, vector)."""
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)], dtype=object)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                rows, fits, x = _kept(b, dim)
                if not len(rows):
                    continue
                code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
                for book, (a, z) in zip(books, cuts(dim)):
                    index, d = book.nearest(x[:, a:z])
                    code, error = code + hexes[index], error + d
                codes, errors = np.full(len(rows), None, object), np.full(len(rows), None, object)
                codes[fits], errors[fits] = code, error
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("label").take(at), pa.array(codes.tolist(), pa.string()),
                     pa.array(errors.tolist(), pa.int64())], names=["id", "label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "label")]
    return vectors.select("id", "label", "vector").mapInArrow(
        run, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 rounds: int = ROUNDS) -> DataFrame:
    """Id, label, code, error, label_error and codebooks_sha256 of every kept row."""
    vectors = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"),
                           F.col(f"`{label_col}`").alias("label"))
    books, dim = train(vectors, rounds=rounds)
    scratch = Scratch(table.sparkSession, "codes")
    coded = scratch.save(encode(vectors, books, dim), "coded")
    # nulls are one label: a key of two columns that are never null
    keyed = coded.withColumns({"none": F.col("label").isNull(), "key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = keyed.groupBy("none", "key").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    out = join_counted(keyed, scratch.save(sums, "labels"), ["none", "key"], "copies", F.xxhash64("id", "code", "error"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
                      F.lit(digest(books)).alias("codebooks_sha256"))
