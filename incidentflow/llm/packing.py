"""Operator 10 - harmonic packing of token ids into sequences of bounded length.

Piece lengths are partitioned into classes by the reciprocals of the capacity C: class j holds
lengths in (C/(j+1), C/j], and each of its bins takes exactly j pieces. Every task fills its own
bins, so nothing is shuffled. Documents are cut so that the classes lose little: whole
sequences first, then the powers of two C/2, C/4, ... down to ``least``, which fill the bins of their
classes exactly; what is left (shorter than ``least``) goes uncut to its class j >= C/least, whose
bins are at least j/(j+1) full. At the end of a task the pieces of bins that did not fill up are
laid end to end and cut at C, the last sequence at powers of two (those need no padding).

Cases: null or empty text: the end id alone. Rows are packed as they are, also with repeated or
null ids; texts of any length; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import WORD_BPE, Encoder, encode_rows
from .common import id_text, slices

CAPACITY = 2048
LEAST = 128
FIELDS = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def cuts(n: int, capacity: int, least: int) -> list[int]:
    """Piece lengths of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while n >= least and n:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """The bins of one task; ``rows`` collects finished pieces (id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next, self.open, self.rows = capacity, task << 40, {}, []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p, self.next, at))
            at += len(p[2])
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // len(piece[2])
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            self.close(own)
            del self.open[k]

    def finish(self) -> None:
        """Lay the pieces of unfilled bins end to end; cut at the capacity, then at powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        room, now = self._room(left), []
        for name, start, ids, total in rest:
            while len(ids):
                take = min(room, len(ids))
                now.append((name, start, ids[:take], total))
                ids, start, room, left = ids[take:], start + take, room - take, left - take
                if not room:
                    self.close(now)
                    room, now = self._room(left), []

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE,
         end_id: int = 1, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. ``capacity`` is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    src = id_text(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc, bins, schema = Encoder(tokenizer), Bins(TaskContext.get().partitionId(), capacity), None

        def out():
            rows, bins.rows = bins.rows, []
            name, start, ids, total, seq, at = zip(*rows)
            return pa.RecordBatch.from_arrays([
                pa.array(name, schema), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()),
                pa.array(seq, pa.int64()), pa.array(at, pa.int64())], names=FIELDS)

        for whole in batches:
            schema = whole.schema.field("id").type
            for b in slices(whole):
                ids, off = encode_rows(enc, b.column("text"), end_id)
                for name, lo, hi in zip(b.column("id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    at = lo
                    for size in cuts(hi - lo, capacity, least):
                        piece = (name, at - lo, ids[at:at + size], hi - lo)
                        if size == capacity:
                            bins.close([piece])
                        else:
                            bins.add((name, at - lo, piece[2].copy(), hi - lo))   # not a view: it may wait
                        at += size
                if bins.rows:
                    yield out()
        bins.finish()
        if bins.rows:
            yield out()

    got = src.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, "
                              "sequence_id long, offset long")
    return got.withColumnRenamed("id", id_col)


def padding(sequences: np.ndarray, capacity: int = CAPACITY) -> int:
    """Padded tokens of sequences of these lengths: to the capacity, none at a power of two."""
    s = np.asarray(sequences, np.int64)
    return int(np.where(s & (s - 1) == 0, 0, capacity - s).sum())
