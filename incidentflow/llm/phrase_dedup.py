"""Operator 13 - repeated phrases: words covered by a window of ``width`` words that a smaller id also has.

1. Candidates. The anchor of a window is its ``GRAM``-word gram with the smallest hash; equal windows have
   equal anchors at the same place. Consecutive windows with one anchor are a run: hash of the anchor, hash of
   all its words, place; no text. Runs whose anchor occurs under one id only cannot repeat and go.
2. Confirmation. Equal runs are a kind; the copy with the smallest id fetches the words of its kind. Kinds of one
   anchor meet in a task, which compares their windows word by word and keeps, for each kind, the passages that
   a smaller id has. (An anchor with more than ``hot`` kinds is compared window by window, by Spark.)
3. Search. Documents are dealt out in small blocks. A block gets each passage that may occur in it once - the
   kinds of which it holds a copy, and the confirmed passages - with the smallest id that has it. Its passages
   are compiled into Aho-Corasick automata (pyahocorasick; shards of bounded size, one after the other)
   and all its documents are streamed through them. Only what an automaton finds, of an id smaller
   than the document's, is removed; so hashes choose what is compared, words decide. (Two different runs or anchors
   with equal 64-bit hashes could only hide a repetition.)

The automata read words as fixed-width codes of the block's own dictionary, each digit from an alphabet of its own,
so a match always begins and ends at words.

Cases: null, empty and blank texts have no words. Fewer words than ``width``: nothing is removed. Rows with
the same id are one document to each other: neither loses to the other. A null id is larger than all others, and null
ids are equal to each other. Texts of any length; an empty table gives an empty result. All columns are kept;
the result is one struct column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import _minimum
from .common import ROW, SPACED, Scratch, mix, powers, ragged, scan_words, slices, text_buffer, window_hash, with_row_key
from .skew import join_counted

WIDTH, GRAM = 13, 5
HOT = 512                      # kinds of one anchor compared in one task
BLOCK_ROWS = 256               # documents of a block (a power of two)
CHUNK = 4 << 20                # bytes of kinds compared at once (whole anchors)
ALPHABET = 512                 # letters of a digit at most
SHARD = 1 << 20                # letters of the passages of one automaton
RESULT = "struct<n_words: bigint, spans: array<struct<lo: bigint, hi: bigint>>, kept: string>"
SPACED_AS_IS = (SPACED[0], np.arange(256, dtype=np.uint8))      # the same words, not lower-cased
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_FACTOR, -1, 1 << 64))


def word_runs(h: np.ndarray, first: np.ndarray, width: int, gram: int):
    """(row, first window, windows, anchor, words) of every run; windows are numbered within the row."""
    none = np.empty(0, np.int64)
    if len(h) < width:
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    g = window_hash(h, gram)
    key = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    at = (_minimum(key, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)    # one for each window
    size = np.diff(first)
    row = np.flatnonzero(size >= width)
    new = np.zeros(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[first[row]] = True
    inside = np.zeros(len(at) + 1, np.int64)
    np.add.at(inside, first[row], 1)
    np.add.at(inside, first[row] + size[row] - width + 1, -1)
    start = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
    own = np.searchsorted(first, start, side="right") - 1
    last = first[own] + size[own] - width + 1
    n = np.minimum(np.append(start[1:], len(at)), last) - start
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(len(h)), dtype=np.uint64)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _INVERSE, np.uint64)]), dtype=np.uint64)
    c = mix((total[start + n + width - 1] - total[start]) * back[start])
    return own, start - first[own], n, g[at[start]], c


def _order(id_col="id"):
    """An id as a value that sorts, a null after all others."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def _run_rows(text: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in slices(whole):
                data, off = text_buffer(b.column("text"))
                first, _, _, h = scan_words(data, off, SPACED_AS_IS)
                row, start, n, anchor, c = word_runs(h, first, width, gram)
                if len(row):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n.astype(np.int32)),
                         b.column(ROW).take(at), b.column("id").take(at), pa.array(start.astype(np.int32))],
                        names=["h", "c", "n", ROW, "id", "start"])

    kind = text.schema["id"].dataType.simpleString()
    return text.mapInArrow(run, f"h long, c long, n int, {ROW} long, id {kind}, start int")


def _joined(data, start, end, lo, hi) -> list[bytes]:
    """Words lo..hi-1 joined by one space, for every pair."""
    own = ragged(lo, hi - lo)
    size = end[own] - start[own] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    k = ragged(at[:-1], size - 1)
    out[k] = data[ragged(start[own], size - 1)]
    edge = np.concatenate([[0], np.cumsum(hi - lo)])
    raw = out.tobytes()
    return [raw[a:max(a, z - 1)] for a, z in zip(at[edge[:-1]].tolist(), at[edge[1:]].tolist())]


def _cut(text: DataFrame, picked: DataFrame, width: int) -> DataFrame:
    """The picked kinds with their words, joined by one space."""
    names = [c for c in picked.columns if c != ROW]
    own = picked.groupBy(ROW).agg(F.collect_list(F.struct(*names)).alias("r"))      # at most the runs of a text
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                data, off = text_buffer(b.column("text"))
                first, start, end, _ = scan_words(data, off, SPACED_AS_IS, hashes=False)
                lists = b.column("r")
                r = lists.flatten()
                count = np.diff(np.asarray(lists.offsets, np.int64))
                lo = np.repeat(first[:-1], count) + np.asarray(r.field("start"), np.int64)
                got = _joined(data, start, end, lo, lo + np.asarray(r.field("n"), np.int64) + width - 1)
                row = b.column(ROW).take(pa.array(np.repeat(np.arange(b.num_rows), count)))
                yield pa.RecordBatch.from_arrays([*(r.field(c) for c in names), row, pa.array(got, pa.binary())],
                                                 names=[*names, ROW, "words"])

    return text.join(own, ROW).select(ROW, "text", "r").mapInArrow(run, f"{kinds}, {ROW} long, words binary")


def _scan(texts: list[bytes]):
    """(first word of each text, code of every word, bytes, places of the words) of texts of words; a new line stands
    after each text, so there is a byte of white space after each word."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first, start, end, _ = scan_words(data, np.concatenate([[0], np.cumsum(size)]), SPACED_AS_IS, hashes=False)
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start),
                                  [None, pa.py_buffer(off), pa.py_buffer(data[SPACED[0][data]])])
    return first, np.asarray(words.dictionary_encode().indices, np.int64), data, start, end


def _kept_text(data, first, start, end, stay) -> list[bytes]:
    """Per text of a scan: the words that stay, joined by one space."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[stay]] += 1
    edge[end[stay] + 1] -= 1                                   # with the byte of white space after a word
    out = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    at = np.concatenate([[0], np.cumsum(end[stay] - start[stay] + 1)])
    out[at[1:] - 1] = 0x20
    raw, row = out.tobytes(), at[np.concatenate([[0], np.cumsum(stay)])[first]].tolist()
    return [raw[a:max(a, z - 1)] for a, z in zip(row, row[1:])]


def _ranks(ids: list) -> np.ndarray:
    """Positions of the ids in their order, nulls last."""
    order = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
    return np.array([order.get(v, len(order)) for v in ids], np.int64)


def _confirmed(cut: DataFrame, width: int, chunk: int) -> DataFrame:
    """Passages of a kind that a smaller id has in another kind of its anchor: (h, c, n, copies, own, words, id)."""
    fields = ["h", "c", "n", "copies", "own"]

    def solve(part):
        ids, texts = part.column("own").to_pylist(), part.column("words").to_pylist()
        first, code, data, start, end = _scan(texts)
        n, rank = np.diff(first) - width + 1, _ranks(ids)
        at = ragged(first[:-1], n)                             # the first word of every window
        own = np.repeat(np.arange(len(n)), n)
        w = np.ascontiguousarray(np.stack([code[at + i] for i in range(width)], axis=1).astype(np.int32))
        _, kind = np.unique(w.view(np.dtype((np.void, 4 * width))).ravel(), return_inverse=True)
        least = np.full(int(kind.max()) + 1, len(rank) + 1)
        np.minimum.at(least, kind, rank[own])
        least = least[kind]
        hit = least < rank[own]
        edge = np.append(True, (own[1:] != own[:-1]) | (least[1:] != least[:-1]) | ~hit[1:] | ~hit[:-1])
        lo = np.flatnonzero(edge & hit)
        stop = np.append(np.flatnonzero(edge), len(own))
        hi = stop[np.searchsorted(stop, lo, side="right")]     # windows [lo, hi) of one kind and one smaller id
        name = dict(zip(rank.tolist(), ids))
        words = _joined(data, start, end, at[lo], at[hi - 1] + width)
        return own[lo], words, [name[v] for v in least[lo].tolist()]

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            part = pa.Table.from_batches(held).combine_chunks()
            own, words, owner = solve(part)
            if len(own):
                own = part.select(fields).take(pa.array(own)).combine_chunks()
                cols = [c.chunk(0) for c in own.columns]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(words, pa.binary()), pa.array(owner, part.schema.field("own").type)],
                    names=[*fields, "words", "id"])

        for b in batches:
            h = np.asarray(b.column("h"))
            edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]).tolist()
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if size >= chunk and h[lo] != last:
                    yield from flush()
                    held, size = [], 0
                held.append(b.slice(lo, hi - lo))
                size, last = size + int(pa.compute.sum(pa.compute.binary_length(held[-1].column("words"))).as_py()), h[lo]
        if held:
            yield from flush()

    return (cut.select(*fields, "words").repartition("h").sortWithinPartitions("h").mapInArrow(run, _passage_schema(cut)))


def _passage_schema(cut: DataFrame) -> str:
    kind = cut.schema["own"].dataType.simpleString()
    return f"h long, c long, n int, copies long, own {kind}, words binary, id {kind}"


def _windows(cut: DataFrame, width: int) -> DataFrame:
    """Every window of the kinds: (h, c, n, copies, own, words)."""
    fields = ["h", "c", "n", "copies", "own"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                first, _, data, start, end = _scan(part.column("words").to_pylist())
                n = np.diff(first) - width + 1
                at = ragged(first[:-1], n)
                own = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(own) for c in fields), pa.array(_joined(data, start, end, at, at + width),
                                                                           pa.binary())], names=[*fields, "words"])

    return cut.select(*fields, "words").mapInArrow(run, _passage_schema(cut).rsplit(",", 1)[0])


def passages(text: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM, hot: int = HOT,
             chunk: int = CHUNK) -> DataFrame:
    """(block, words, id): passages that a block of documents may hold, with the smallest id that has them."""
    block = F.shiftrightunsigned(F.col(ROW), BLOCK_ROWS.bit_length() - 1)
    anchors = _run_rows(text, width, gram).groupBy("h").agg(
        F.count("*").alias("copies"), F.count("id").alias("known"), F.min("id").alias("a"), F.max("id").alias("b"))
    anchors = anchors.filter("a <> b OR (known > 0 AND known < copies)")          # under several ids
    anchors = scratch.save(anchors.select("h", "copies"), "anchors")
    found = scratch.save(join_counted(_run_rows(text, width, gram), anchors, ["h"], "copies", F.xxhash64(ROW, "start"),
                                       hashed=True), "found")
    scratch.drop("anchors")
    held = found.groupBy(block.alias("block"), "h", "c", "n").agg(
        F.count("*").alias("copies"), F.max(_order()).alias("top"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW, "start")).alias("one"))
    held = scratch.save(held, "held")                          # the kinds that a block holds
    scratch.drop("found")
    kinds = held.groupBy("h", "c", "n").agg(F.count("*").alias("copies"), F.min("one").alias("one"),
                                            F.max("top").alias("top"))
    kinds = kinds.select("h", "c", "n", "copies", F.col("one.id").alias("own"), f"one.{ROW}", "one.start",
                         (F.struct("one.none", "one.id") < F.col("top")).alias("shared"))
    kinds = scratch.save(kinds, "kinds")
    cut = scratch.save(_cut(text, kinds, width), "cut")
    several = scratch.save(kinds.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "several")
    scratch.drop("kinds")
    few = _confirmed(cut.join(several.filter(F.col("k") <= hot).select("h"), "h", "left_semi"), width, chunk)
    rows = scratch.save(_windows(cut.join(several.filter(F.col("k") > hot).select("h"), "h", "left_semi"), width), "many")
    least = rows.groupBy("words").agg(F.count("*").alias("uses"), F.min(_order("own")).alias("a"),
                                      F.max(_order("own")).alias("b"))
    least = scratch.save(least.filter("a < b").select("words", "uses", "a"), "least")
    many = join_counted(rows, least, ["words"], "uses", F.xxhash64("h", "c"), hashed=True).filter(_order("own") > F.col("a"))
    many = many.select("h", "c", "n", "copies", "own", "words", F.col("a.id").alias("id"))
    # at most one passage for each window of a run
    listed = few.unionByName(many).groupBy("h", "c", "n", "copies", "own").agg(
        F.collect_list(F.struct("words", "id")).alias("p"))
    listed = scratch.save(listed, "listed")
    scratch.drop("many", "least", "several")
    key = ["h", "c", "n"]
    # the kinds of a block whose smallest id is not the block's largest with them, and the confirmed passages
    copies = join_counted(held.select("block", *key, "top"), cut.filter("shared").select(*key, "copies", "words", "own"),
                          key, "copies", F.xxhash64("block"), hashed=True).filter(F.col("top") > _order("own"))
    other = join_counted(held.select("block", *key, "one.id"), listed, key, "copies", F.xxhash64("block"), hashed=True)
    other = other.filter(F.col("id").eqNullSafe(F.col("own"))).select("block", F.explode("p").alias("p"))
    found = scratch.save(copies.select("block", "words", F.col("own").alias("id")).unionByName(
        other.select("block", "p.words", "p.id")), "passages")
    scratch.drop("held", "cut", "listed")
    return found


def _codes(code: np.ndarray) -> tuple[str, int]:
    """All words as letters, a fixed number for each; every digit has letters of its own."""
    most = int(code.max(initial=0)) + 1
    digits = next(d for d in range(1, 9) if ALPHABET ** d >= most)
    base = max(next(n for n in range(1, ALPHABET + 1) if n ** digits >= most), 2)
    out = np.empty((len(code), digits), "<u4")
    for i in range(digits):
        out[:, i] = code // base ** i % base + i * base
    return out.tobytes().decode("utf-32-le"), digits


def _search(words: list[bytes], owners: list, texts: list[bytes], ids: list, width: int, shard: int):
    """Per text (number of words, removed spans of words, kept words joined by one space)."""
    import ahocorasick
    first, code, data, start, end = _scan(words + texts)
    p, n = len(words), np.diff(first)
    rank = _ranks(owners + ids)
    letters, digits = _codes(code)
    change = np.zeros(len(code) + 1, np.int64)                 # +1 where a removed span begins, -1 where it ends
    todo: dict[str, tuple[int, int]] = {}
    size = 0

    def run():
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for key, value in todo.items():
            automaton.add_word(key, value)
        automaton.make_automaton()
        for i in range(p, p + len(texts)):
            if n[i] >= width:
                own, base = rank[i], int(first[i])
                for stop, (least, m) in automaton.iter(letters[base * digits:int(first[i + 1]) * digits]):
                    if least < own:
                        hi = base + (stop + 1) // digits
                        change[hi - m] += 1
                        change[hi] -= 1

    for i in range(p):
        key = letters[int(first[i]) * digits:int(first[i + 1]) * digits]
        value = (int(rank[i]), int(n[i]))
        if key not in todo:
            size += len(key)
        todo[key] = min(todo.get(key, value), value)
        if size >= shard:
            run()
            todo.clear()
            size = 0
    if todo:
        run()
    gone = np.cumsum(change[:-1]) > 0
    kept = _kept_text(data, first[p:], start, end, ~gone)
    out = []
    for i, text in zip(range(p, p + len(texts)), kept):
        own = gone[first[i]:first[i + 1]]
        edge = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2) if own.any() else []
        out.append({"n_words": int(n[i]), "spans": [{"lo": int(a), "hi": int(b)} for a, b in edge],
                    "kept": text.decode()})
    return out


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    gram: int = GRAM, into: str = "phrases", hot: int = HOT, chunk: int = CHUNK,
                    shard: int = SHARD) -> DataFrame:
    """``docs`` with a struct column: n_words, spans (removed words, [lo, hi)), kept (text of the rest)."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    spark, keyed = docs.sparkSession, with_row_key(docs)
    scratch = Scratch(spark, "phrases")
    text = keyed.select(ROW, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = passages(text, scratch, width, gram, hot, chunk)
    block = F.shiftrightunsigned(F.col(ROW), BLOCK_ROWS.bit_length() - 1).alias("block")
    rest = [c for c in docs.columns if c != text_col]          # the text travels once
    whole = keyed.select(block, F.lit(True).alias("document"), F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{text_col}`").cast("string").cast("binary").alias("words"),
                         F.struct(F.lit(0).alias(into), *[F.col(f"`{c}`") for c in rest]).alias("row"))
    none = F.lit(None).cast(whole.schema["row"].dataType)
    both = whole.unionByName(parts.select("block", F.lit(False).alias("document"), "id", "words", none.alias("row")))
    schema = T.StructType([T.StructField("row", whole.schema["row"].dataType), T.StructField("text", T.BinaryType()),
                           T.StructField("result", T._parse_datatype_string(RESULT))])

    def run(batches):
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                          ("kept", pa.string())])
        last, held, known, rows = None, [], {}, []

        def flush():
            if not rows:
                return
            texts, ids = [t or b"" for _, t in held], [i for i, _ in held]
            out = _search([w for w, _ in known], [i for _, i in known], texts, ids, width, shard)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows), pa.array([t for _, t in held], pa.binary()),
                                              pa.array(out, kind)], names=["row", "text", "result"])

        for b in batches:
            blocks = np.asarray(b.column("block"))
            edges = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == z:
                    continue
                if blocks[a] != last:
                    yield from flush()
                    last, held, known, rows = blocks[a], [], {}, []
                part = b.slice(a, z - a)
                doc = part.column("document")
                for i, w in zip(*(part.filter(pa.compute.invert(doc)).column(k).to_pylist() for k in ("id", "words"))):
                    known[(w, i)] = True
                part = part.filter(doc)
                if part.num_rows:
                    held += zip(part.column("id").to_pylist(), part.column("words").to_pylist())
                    rows.append(part.column("row"))
        yield from flush()

    out = both.repartition("block").sortWithinPartitions("block", "document").mapInArrow(run, schema)
    text = F.col("text").cast("string").cast(docs.schema[text_col].dataType).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns], F.col("result").alias(into))
