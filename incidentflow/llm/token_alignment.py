"""Operator 11 - alignment of two tokenizers' tokens on the bytes of a text.

Tokenizer A (a byte-level BPE file of the ``tokenizers`` library) reads a space and the text, tokenizer B (a sentencepiece
model, which puts the space itself) the text; so both cut the same bytes. A's character offsets and
B's proto spans are coarse cuts; where tokens share a character (A) or are bytes of one (B's byte
fallback), the tokens' decoded bytes refine them. Byte places where tokens of both end cut the text into groups;
tokens whose byte ranges overlap are linked; a pair of ids counts as many links as the corpus has of it.

Neither tokenizer joins a space with what stands before it, so a text is cut into chunks (a space and what follows)
that are encoded independently: each distinct chunk of a slice once, many in one call. That is
checked against the vocabularies (no piece of B holds its space mark after another character, A splits by the
byte-level pattern); with other files a text is one chunk, encoded by itself.

Pass one writes, for each slice of texts, its distinct pairs with their links, the pairs of its chunks, and the documents as
chunk numbers. The pairs are added up by Spark, each B id's highest count found, and sent back to the
slices; pass two scores the chunks of a slice and sums them over its documents. A slice holds a bounded
number of bytes (a longer text is one slice); nothing reaches the driver.

Cases: null or empty texts, and texts whose joined token bytes of A or B are not the space and the text (for
instance with a U+2581), have no tokens: zeros and an empty string, and they add no links. The strings of special
tokens are plain text. Repeated rows and ids count each. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import Scratch, id_text, kept, ragged, released, slices, text_buffer

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE = 8 << 20                # text bytes whose chunks are encoded together
CALL = 1 << 16                 # bytes of chunks joined in one call of the libraries
LEAD = " a"                    # stands before the chunks of a call
MARK = "\u2581"                # sentencepiece's space


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters are
    themselves, the other bytes follow in order from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the byte strings of their ids."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(vocabulary_path(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b_file))
        vocabulary, letter = self.a.get_vocab(), byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for k, i in vocabulary.items():
            self.a_bytes[i] = bytes(letter[c] for c in k) if all(c in letter for c in k) else k.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace(MARK, " ").encode()
                        for p, raw in zip(pieces, self.fallback)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        file = json.loads(self.a.to_str())
        splits = file["pre_tokenizer"] or {}
        self.chunked = (splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not file["normalizer"]
                        and not any(MARK in p.lstrip(MARK) for p in pieces))
        # each id followed by ',', by '|' (A) or ';' (B)
        self.text = [str(i) + s for i in range(len(self.a_bytes)) for s in ",|"]
        self.b_at = len(self.text)
        self.text += [str(i) + s for i in range(len(self.b_bytes)) for s in ",;"]
        self.text_size = np.array([len(x) for x in self.text], np.int64)

    @staticmethod
    def _refined(coarse: np.ndarray, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: the coarse ends where ``cut``, between them by the decoded sizes."""
        total = np.cumsum(size)
        at = np.flatnonzero(cut)
        before = np.searchsorted(at, np.arange(len(size)), side="left") - 1      # the last cut before a token
        known = np.where(before >= 0, coarse[at[before]] - total[at[before]], 0) if len(at) else 0
        return np.where(cut, coarse, total + known)

    def _a(self, text: str, raw: bytes):
        code = self.a.encode(text, add_special_tokens=False)
        ids, span = np.array(code.ids, np.int64), np.array(code.offsets, np.int64).reshape(-1, 2)
        if len(text) == len(raw):
            byte = np.arange(len(raw) + 1)
        else:
            byte = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        # a cut: the next token begins at or after this one's end
        cut = np.append(span[1:, 0] >= span[:-1, 1], True) if len(ids) else np.empty(0, bool)
        return ids, self._refined(byte[span[:, 1]], cut, self.a_size[ids])

    def _b(self, text: str):
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        ids = np.fromiter((p.id for p in pieces), np.int64, len(pieces))
        end = np.fromiter((p.end for p in pieces), np.int64, len(pieces)) + 1
        # bytes of one character have its span only at their last
        cut = np.append(~(self.fallback[ids[:-1]] & self.fallback[ids[1:]]), True) if len(ids) else np.empty(0, bool)
        return ids, self._refined(end, cut, self.b_size[ids])

    def encode(self, text: str, raw: bytes):
        """(A's ids, their byte ends, B's, theirs) of a text with its space; None where the bytes differ."""
        lead = LEAD if self.chunked else ""                    # so that B puts its space before the lead
        a, a_end = self._a(lead + text, lead.encode() + raw)
        b, b_end = self._b(lead + text)
        if lead:
            n = len(lead)
            if not (a_end == n).any() or not (b_end == n).any():
                return None
            a, a_end, b, b_end = a[a_end > n], a_end[a_end > n] - n, b[b_end > n], b_end[b_end > n] - n
        for ids, end, table, sizes in ((a, a_end, self.a_bytes, self.a_size), (b, b_end, self.b_bytes, self.b_size)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw or not np.array_equal(end, np.cumsum(sizes[ids])):
                return None
        return a, a_end, b, b_end

    def align(self, chunks: list[str]):
        """Per chunk: counts (A, B, groups, links; A < 0 where the bytes differ), groups as text, pairs (flat)."""
        raw = [c.encode() for c in chunks]
        size = np.array([len(r) for r in raw], np.int64)
        call = np.cumsum(size) // CALL
        # nothing follows a chunk that ends with white space (the end of a text) in a call
        ends = np.array([not self.chunked or c[-1].isspace() or c[-1] == MARK for c in chunks], bool)
        counts, texts, pairs = [], [], []
        edges = np.concatenate([[0], np.flatnonzero((np.diff(call) > 0) | ends[:-1]) + 1, [len(chunks)]]).tolist()
        for lo, hi in zip(edges, edges[1:]):
            todo = [(lo, hi)]
            while todo:
                x, y = todo.pop()
                if x == y:
                    continue
                got = self.encode("".join(chunks[x:y]), b"".join(raw[x:y]))
                end = np.cumsum(size[x:y])
                if got is None or not (np.isin(end, got[1]).all() and np.isin(end, got[3]).all()):
                    if y - x > 1:                              # halves, down to the chunk that does not fit
                        todo += [((x + y) // 2, y), (x, (x + y) // 2)]
                        continue
                    counts.append(np.array([[-1, 0, 0, 0]]))
                    texts.append(b"")
                    continue
                one = self._groups(*got, end)
                counts.append(one[0])
                texts += one[1]
                pairs.append(one[2])
        flat = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
        return np.concatenate(counts) if counts else np.empty((0, 4), np.int64), texts, flat

    def _groups(self, a, a_end, b, b_end, end):
        """Counts, group texts and pairs of the chunks that end at the bytes ``end``."""
        a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        own_a, own_b = np.searchsorted(end, a_end), np.searchsorted(end, b_end)
        lo, hi = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
        links = hi - lo
        pair = (np.repeat(a, links) << 32) | b[ragged(lo, links)]
        n = len(end)
        counts = np.stack([np.bincount(own_a, minlength=n), np.bincount(own_b, minlength=n),
                           np.bincount(np.searchsorted(end, both), minlength=n),
                           np.bincount(own_a, links, minlength=n).astype(np.int64)], axis=1)
        # tokens by group, A's before B's: a token's place is its number and those of the other side before it
        before_a = np.append(0, np.searchsorted(a_end, both, side="right"))
        before_b = np.append(0, np.searchsorted(b_end, both, side="right"))
        word = np.empty(len(a) + len(b), np.int64)
        word[np.arange(len(a)) + before_b[np.searchsorted(both, a_end)]] = 2 * a + np.isin(
            a_end, both, assume_unique=True)
        word[np.arange(len(b)) + before_a[np.searchsorted(both, b_end) + 1]] = 2 * b + self.b_at + np.isin(
            b_end, both, assume_unique=True)
        flat = "".join(map(self.text.__getitem__, word.tolist())).encode()
        ends = np.searchsorted(a_end, end, side="right") + np.searchsorted(b_end, end, side="right")
        at = np.concatenate([[0], np.concatenate([[0], np.cumsum(self.text_size[word])])[ends]]).tolist()
        return counts, [flat[x:y] for x, y in zip(at, at[1:])], pair


def chunk_cuts(data: np.ndarray, off: np.ndarray, chunked: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk of every text, first byte of every chunk): a chunk begins with a text, and at a space after a
    character that is surely no white space (ASCII, or of a lead byte under which there is none)."""
    size = np.diff(off)
    new = np.zeros(len(data), bool)
    new[off[:-1][size > 0]] = True
    if chunked and len(data) > 1:
        at = np.flatnonzero(data[1:] == 0x20)                  # bytes before a space
        solid = (data[at] > 0x20) & (data[at] != 0x7F)
        wide = np.flatnonzero(data[at] >= 0x80)
        lead = at[wide]                                        # of the character that such a byte ends
        for _ in range(3):
            lead = lead - ((data[lead] & 0xC0) == 0x80)
        # lead bytes of U+0085, U+00A0, U+1680, U+2000 to U+205F, U+2581 and U+3000
        solid[wide] = ~np.isin(data[lead], [0xC2, 0xE1, 0xE2, 0xE3])
        new[at[solid] + 1] = True
    start = np.flatnonzero(new)
    return np.searchsorted(start, off), start


def _slice_rows(src: DataFrame, a_file: str, b_file: str, most: int) -> DataFrame:
    """Rows of the slices: kind 0 the pairs of the slice's chunks, 1 its distinct pairs with their links, 2 documents."""
    kind = src.schema["id"].dataType.simpleString()
    schema = (f"slice long, kind int, at int, a int, b int, n long, id {kind}, n_a long, n_b long, n_groups long, "
              f"n_links long, groups string, body binary")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), None, *(pa.int64(),) * 4, pa.string(),
             pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        aligner = kept(Aligner, vocabulary_path(a_file), vocabulary_path(b_file))

        def rows(m, id_type, **cols):
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[k], t or id_type) if k in cols else pa.nulls(m, t or id_type) for k, t in zip(names, types)],
                names=names)

        for whole in batches:
            id_type = whole.schema.field("id").type
            for batch in slices(whole, most=most):
                data, off = text_buffer(batch.column("text"))
                number = int(batch.column("row")[0].as_py())
                first, start = chunk_cuts(data, off, aligner.chunked)
                edge = np.append(start, len(data)).astype(np.int64)
                array = pa.Array.from_buffers(pa.large_string(), len(start),
                                              [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))])
                coded = array.dictionary_encode()
                code = np.array(coded.indices, np.int32)
                # the first chunk of a text has no space of its own: it gets one, so it is another string
                head = np.zeros(len(code), bool)
                head[first[:-1][np.diff(first) > 0]] = True
                values = coded.dictionary.to_pylist()
                del array, coded, edge
                heads, inverse = np.unique(code[head], return_inverse=True)
                plain, body = np.unique(code[~head], return_inverse=True)
                number_of: dict[str, int] = {}
                for v in (*(" " + values[i] for i in heads.tolist()), *(values[i] for i in plain.tolist())):
                    number_of.setdefault(v, len(number_of))
                code[head] = np.array([number_of[" " + values[i]] for i in heads.tolist()], np.int32)[inverse]
                code[~head] = np.array([number_of[values[i]] for i in plain.tolist()], np.int32)[body]
                values = list(number_of)
                del number_of, inverse, body, head
                counts, texts, pair = aligner.align(values)
                del values
                # documents with a chunk that does not fit have no tokens
                bad = np.concatenate([[0], np.cumsum(counts[code, 0] < 0)])
                good = bad[first[1:]] == bad[first[:-1]]
                used = np.bincount(code[np.repeat(good, np.diff(first))], minlength=len(counts)).astype(np.int64)
                distinct, index = np.unique(pair, return_inverse=True)
                links = np.bincount(index, np.repeat(used, counts[:, 3]), minlength=len(distinct)).astype(np.int64)
                live = np.flatnonzero(links)
                yield rows(1, id_type, slice=[number], kind=[0], at=[len(distinct)],
                           body=[counts[:, 3].astype("<i4").tobytes() + index.astype("<i4").tobytes()], n=[len(counts)])
                m = len(live)
                yield rows(m, id_type, slice=np.full(m, number), kind=np.ones(m, np.int32), at=live.astype(np.int32),
                           a=(distinct[live] >> 32).astype(np.int32), b=(distinct[live] & 0xFFFFFFFF).astype(np.int32),
                           n=links[live])
                total = []
                for one in counts.T:
                    run_total = np.concatenate([[0], np.cumsum(one[code])])
                    total.append(np.where(good, run_total[first[1:]] - run_total[first[:-1]], 0))
                digests, codes = [], []
                for lo, hi, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist()):
                    own = code[lo:hi] if ok else code[:0]
                    text = b"".join(map(texts.__getitem__, own.tolist()))[:-1]
                    digests.append(hashlib.sha256(text).hexdigest() if text else "")
                    codes.append(own.astype("<i4").tobytes())
                m = batch.num_rows
                doc = rows(m, id_type, slice=np.full(m, number), kind=np.full(m, 2, np.int32), n_a=total[0], n_b=total[1],
                           n_groups=total[2], n_links=total[3], groups=digests, body=codes)
                yield doc.set_column(names.index("id"), "id", batch.column("id"))

    return src.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE,
                 b_file: str = B_FILE, most: int = SLICE) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "align")
    src = id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    first = scratch.save(_slice_rows(src, a_file, b_file, most), "slices")
    pairs = first.filter("kind = 1").select("slice", "at", "a", "b", "n")
    count = pairs.groupBy("a", "b").agg(F.sum("n").alias("links"))
    count = scratch.save(count, "pairs")
    best = count.groupBy("b").agg(F.max("links").alias("most"))
    count = count.join(best, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))
    back = pairs.join(count, ["a", "b"]).select("slice", F.lit(1).alias("kind"), "at", "links", "best")
    both = first.filter("kind <> 1").drop("a", "b").unionByName(back, allowMissingColumns=True)
    kind = src.schema["id"].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        released(Aligner)                                      # pass two needs no tokenizers, but their memory
        score = highest = links = best = number = index = None
        ready = False

        for b in batches:
            key = 4 * np.asarray(b.column("slice"), np.int64) + np.asarray(b.column("kind"), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part, what = b.slice(lo, hi - lo), int(key[lo]) & 3
                if what == 0:
                    chunks, raw = part.column("n")[0].as_py(), np.frombuffer(part.column("body")[0].as_py(), "<i4")
                    number, index = raw[:chunks], raw[chunks:]
                    links = np.zeros(part.column("at")[0].as_py(), np.int64)
                    best, ready = np.zeros(len(links), np.int64), False
                elif what == 1:
                    at = np.asarray(part.column("at"))
                    links[at], best[at] = np.asarray(part.column("links")), np.asarray(part.column("best"))
                else:
                    if not ready:                              # all pairs of the slice have come
                        edge = np.concatenate([[0], np.cumsum(number)])
                        score, highest = (np.diff(np.concatenate([[0], np.cumsum(v[index])])[edge]) for v in (links, best))
                        ready = True
                    raw = part.column("body")
                    flat = np.frombuffer(b"".join(raw.to_pylist()), "<i4")
                    at = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(raw), np.int64) // 4)])
                    total = [np.diff(np.concatenate([[0], np.cumsum(v[flat])])[at]) for v in (highest, score)]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")),
                         *(pa.array(t, pa.int64()) for t in total), part.column("groups")], names=names)

    longs = ", ".join(f"{c} long" for c in names[1:7])
    return both.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(
        run, f"`{id_col}` {kind}, {longs}, groups_sha256 string")
