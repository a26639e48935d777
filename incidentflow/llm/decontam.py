"""Operator 7 - benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``k`` consecutive words of the benchmark items (a shorter item is one
window). The symbols are word hashes and a block is two words. SHIFT says how far the search may
jump when a block ends at a position; only where it is 0 the bucket of patterns with that suffix
block is looked at, windows are compared by hash, and the words themselves confirm an occurrence.
Texts are cut into overlapping lanes of windows that advance together.

The patterns are broadcast in blocks of at most ``block_bytes`` of item text (their tables are a
small multiple of it); a larger benchmark is searched block by block and the hits of a document
are merged, so the result does not depend on the number of blocks. Very long items are cut
into overlapping pieces that hold each window once.

Cases: null or empty text: no words, not contaminated. Items without words have no window; an item
with a null id marks words, but is not listed. Repeated items and rows count as they are (an
item is listed once); an empty benchmark hits nothing; an empty table gives an empty result. All
columns of ``docs`` are kept; the result is added as one struct column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (ALNUM, ROW, Scratch, id_text, mix, powers, ragged, scan_words, slices, text_buffer,
                     window_hash, with_row_key)

K = 10
BLOCK_BYTES = 4 << 20
PIECE_WINDOWS = 20_000
LANE = 256                     # windows of a lane
SPAN = "struct<lo: bigint, hi: bigint>"
RESULT = f"struct<n_words: bigint, spans: array<{SPAN}>, items: array<string>>"


class WuManber:
    """Occurrences of patterns of m symbols each in sequences of 64-bit symbols."""

    def __init__(self, patterns: np.ndarray):
        self.m = patterns.shape[1]
        self.b = min(2, self.m)
        self.jump = self.m - self.b + 1
        blocks = np.stack([self._hash(patterns[:, j:j + self.b]) for j in range(self.jump)], axis=1)
        bits = min(max(int(16 * blocks.size).bit_length(), 12), 24)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, min(self.jump, 255), np.uint8)
        np.minimum.at(self.shift, (blocks & self.mask).astype(np.int64),
                      np.arange(self.jump - 1, -1, -1).clip(0, 255).astype(np.uint8)[None, :])
        suffix = blocks[:, -1]
        self.order = np.argsort(suffix, kind="stable")           # buckets by the suffix block
        self.suffix = suffix[self.order]
        self.whole = self._hash(patterns)[self.order]

    @staticmethod
    def _hash(x: np.ndarray) -> np.ndarray:
        return mix((x * powers(x.shape[1])).sum(axis=1, dtype=np.uint64))

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word of the window, pattern) of every window with a pattern's hash; rows are
        h[first[i]:first[i + 1]]."""
        n = np.diff(first) - self.m + 1                          # windows of each row
        rows = np.flatnonzero(n > 0)
        none = np.empty(0, np.int64)
        if not len(rows) or not len(self.whole):
            return none, none
        lanes = -(-n[rows] // LANE)
        at = np.repeat(first[:-1][rows], lanes) + LANE * ragged(np.zeros(len(rows), np.int64), lanes)
        stop = np.minimum(at + LANE, np.repeat(first[:-1][rows] + n[rows], lanes))
        back = self.m - self.b                                   # from a window's start to its last block
        blocks, found = window_hash(h, self.b), []
        step = self.shift[(blocks & self.mask).astype(np.int64)]
        while len(at):
            s = step[at + back]
            zero = s == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(s, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        at = np.concatenate(found)
        key = blocks[at + back]
        lo = np.searchsorted(self.suffix, key, side="left")
        count = np.searchsorted(self.suffix, key, side="right") - lo
        at, count, lo = at[count > 0], count[count > 0], lo[count > 0]
        if not len(at):
            return none, none
        mine = self._hash(h[at[:, None] + np.arange(self.m)])
        pick, own = ragged(lo, count), np.repeat(np.arange(len(at)), count)
        same = self.whole[pick] == mine[own]
        return at[own[same]], self.order[pick[same]]


class Patterns:
    """The windows of a block of benchmark pieces: searchers by length, words and items."""

    def __init__(self, pieces: list[tuple[str | None, str]], k: int = K):
        col = pa.array([t for _, t in pieces], pa.string())
        data, off = text_buffer(col)
        first, start, end, h = scan_words(data, off, ALNUM)
        joined = ALNUM[1][data].tobytes()
        by: dict[int, dict[bytes, set]] = {}
        at: dict[int, list[int]] = {}
        for i, (name, _) in enumerate(pieces):
            n = int(first[i + 1] - first[i])
            m = min(n, k)
            for w in range(first[i], first[i + 1] - m + 1) if n else ():
                key = joined[start[w]:end[w + m - 1]]         # pieces have one blank between words
                own = by.setdefault(m, {})
                if key not in own:
                    own[key] = set()
                    at.setdefault(m, []).append(w)
                if name is not None:
                    own[key].add(name)
        self.groups = []
        for m, own in sorted(by.items()):
            w = np.array(at[m], np.int64)
            self.groups.append((WuManber(h[w[:, None] + np.arange(m)]), list(own), [sorted(v) for v in own.values()]))

    def state(self) -> list:
        """Plain values, to be broadcast."""
        return [(vars(w), text, names) for w, text, names in self.groups]

    @classmethod
    def of(cls, state: list) -> "Patterns":
        own = cls.__new__(cls)
        own.groups = []
        for values, text, names in state:
            w = WuManber.__new__(WuManber)
            vars(w).update(values)
            own.groups.append((w, text, names))
        return own

    def find(self, data, off):
        """(words of each row, hit spans of each row, items of each row)."""
        first, start, end, h = scan_words(data, off, ALNUM)
        rows = len(off) - 1
        spans, items = [[] for _ in range(rows)], [set() for _ in range(rows)]
        change, lower = np.zeros(len(h) + 1, np.int64), ALNUM[1]
        for search, text, names in self.groups:
            at, which = search.search(h, first)
            row = np.searchsorted(first, at, side="right") - 1
            for a, p, r in zip(at.tolist(), which.tolist(), row.tolist()):
                own = b" ".join(lower[data[s:e]].tobytes()
                                for s, e in zip(start[a:a + search.m], end[a:a + search.m]))
                if own == text[p]:                               # direct comparison
                    change[a] += 1
                    change[a + search.m] -= 1
                    items[r].update(names[p])
        hit = np.cumsum(change[:-1]) > 0 if len(h) else np.zeros(0, bool)
        for r in np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist():
            own = np.concatenate([[False], hit[first[r]:first[r + 1]], [False]])
            edge = np.flatnonzero(own[1:] != own[:-1])
            spans[r] = [{"lo": int(a), "hi": int(b)} for a, b in edge.reshape(-1, 2)]
        return np.diff(first), spans, [sorted(x) for x in items]


def pieces_of(benchmark: DataFrame, id_col: str, text_col: str, k: int, windows: int) -> DataFrame:
    """Items cut into pieces of at most ``windows`` windows: item, piece, words (one blank between them)."""
    def run(batches):
        word, lower = ALNUM
        table = bytes(int(lower[b]) if word[b] else 32 for b in range(256))
        for b in batches:
            name, piece, text = [], [], []
            for i, t in zip(b.column("id").to_pylist(), pc.fill_null(b.column("text"), "").to_pylist()):
                w = t.encode().translate(table).split()
                for n, lo in enumerate(range(0, max(len(w) - k + 1, 1) if w else 0, windows)):
                    name.append(i)
                    piece.append(n)
                    text.append(b" ".join(w[lo:lo + windows + k - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(piece, pa.int64()),
                                              pa.array(text, pa.string())], names=["item", "piece", "words"])

    src = id_text(benchmark, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    return src.mapInArrow(run, "item string, piece long, words string")


def _annotated(docs: DataFrame, text_col: str, into: str, shared) -> DataFrame:
    schema = T.StructType(docs.schema.fields + [T.StructField(into, T._parse_datatype_string(RESULT))])

    def run(batches):
        kind = pa.struct([("n_words", pa.int64()),
                          ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                          ("items", pa.list_(pa.string()))])
        patterns = Patterns.of(shared.value)
        for whole in batches:
            for b in slices(whole, text_col):
                n, spans, items = patterns.find(*text_buffer(b.column(text_col)))
                got = [{"n_words": int(w), "spans": s, "items": i} for w, s, i in zip(n, spans, items)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, into])

    return docs.mapInArrow(run, schema)


def _merged(spans):
    """Sorted spans with touching ones joined."""
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
        last(a)["lo"].alias("lo"), F.greatest(last(a)["hi"], x["hi"]).alias("hi"))))
    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"),
                       lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["hi"] >= x["lo"]),
                                           joined(a, x)).otherwise(F.concat(a, F.array(x))))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES,
                   into: str = "contamination", piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """``docs`` with a struct column: n_words, spans (hit words, [lo, hi)), items (ids as strings)."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    spark = docs.sparkSession
    pieces = Scratch(spark, "decontam").save(
        pieces_of(benchmark, item_col, item_text, k, piece_windows).distinct(), "pieces")     # repeats would share a block
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    number = F.pmod(F.xxhash64("item", "piece", "words"), F.lit(blocks))

    def block(i):                                     # at most about block_bytes of words
        rows = pieces.filter(number == i).select("item", "words").collect()
        return spark.sparkContext.broadcast(Patterns([(r[0], r[1]) for r in rows], k).state())

    if blocks == 1:
        return _annotated(docs, text_col, into, block(0))
    keyed = with_row_key(docs)
    text = keyed.select(ROW, F.col(f"`{text_col}`").alias("text"))
    more = None
    for i in range(1, blocks):
        hits = (_annotated(text, "text", "_got", block(i)).filter(F.size("_got.spans") > 0)
                .select(ROW, "_got.spans", "_got.items"))
        more = hits if more is None else more.unionByName(hits)
    more = more.groupBy(ROW).agg(F.flatten(F.collect_list("spans")).alias("_spans"),      # of one document
                                 F.flatten(F.collect_list("items")).alias("_items"))
    got = _annotated(keyed, text_col, into, block(0)).join(more, ROW, "left")
    own = F.col(into)
    spans = F.concat(own["spans"], F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")))
    items = F.array_sort(F.array_union(own["items"], F.coalesce("_items", F.array().cast("array<string>"))))
    return got.withColumn(into, F.struct(own["n_words"].alias("n_words"), _merged(spans).alias("spans"),
                                         items.alias("items"))).drop(ROW, "_spans", "_items")


def n_hit(column):
    """Hit words of a result."""
    return F.aggregate(column["spans"], F.lit(0).cast("bigint"), lambda a, x: a + x["hi"] - x["lo"])
