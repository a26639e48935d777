"""Exact token ids by the ``tokenizers`` library, once per distinct word of a slice of texts.

The word-level BPE file lower-cases, drops white space and never merges across it, so a text's
ids are the ids of its white-space separated chunks, one after the other. In texts of ASCII and
Latin-1 letters without apostrophes the file's pattern only separates runs of letters, single digits
and runs of other characters; numpy cuts them there. Arrow dictionary-encodes the pieces,
each distinct one is encoded once by the library's model, and numpy gathers the ids. Other texts are
split at white space and their distinct chunks encoded; a file with another normaliser or
pre-tokenizer is encoded text by text with the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, text_buffer

WORD_BPE = "word_bpe_49k.json"
# --- fixed values: the normaliser and pattern under which chunks are independent ---
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
               {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same pattern for chunks of ASCII and Latin-1 letters only: those are their own NFC form,
# and their lower case does not depend on neighbours.
SIMPLE = "[!-~À-ÖØ-öø-ÿ]+"
SIMPLE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is one of the public tokenizer files."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole string columns; ``most`` bounds the remembered chunks."""

    def __init__(self, path: str = WORD_BPE, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        path = vocabulary_path(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok, self.most = Tokenizer.from_file(path), most
        self.model = self.tok.model
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = ((spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
                        and pre[0].get("pattern") == {"Regex": SPLIT} and pre[-1].get("type") == "ByteLevel"
                        and not pre[-1].get("use_regex", True))
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]      # byte-level alphabet
        rest = [b for b in range(256) if b not in set(keep)]
        self.alphabet = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.simple = re.compile(SIMPLE).fullmatch
        self.split = re.compile(SIMPLE_SPLIT).findall
        # 0 blank, 1 letter, 2 digit, 3 other, 4 not for the fast way (an apostrophe, other scripts)
        kind = np.full(256, 4, np.uint8)
        kind[33:127] = 3
        for lo, hi, k in ((9, 14, 0), (32, 33, 0), (48, 58, 2), (65, 91, 1), (97, 123, 1), (39, 40, 4)):
            kind[lo:hi] = k
        self.kind, self.lower = kind, np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.place: dict[str, int] = {}
        self.pieces: dict[str, array] = {}
        self.flat, self.begin = array("I"), array("q", [0])

    def _piece(self, p: str) -> array:
        s = p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet)
        ids = self.pieces[p] = array("I", [t.id for t in self.model.tokenize(s)])
        return ids

    def _chunk(self, c: str) -> int:
        if self.simple(c) and "<|" not in c:
            get, flat = self.pieces.get, self.flat
            for p in self.split(c.lower()):
                flat.extend(get(p) or self._piece(p))
        else:
            self.flat.extend(array("I", self.tok.encode(c, add_special_tokens=False).ids))
        self.begin.append(len(self.flat))
        at = self.known[c] = len(self.begin) - 2
        return at

    def _piece_place(self, p: str) -> int:
        s = p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet)
        self.flat.extend([t.id for t in self.model.tokenize(s)])
        self.begin.append(len(self.flat))
        at = self.place[p] = len(self.begin) - 2
        return at

    def _fast(self, data: np.ndarray, off: np.ndarray):
        """(rows for which it holds, ids of those, count of each row)."""
        kind, low = self.kind[data], self.lower[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.empty(0, np.int64)
        after = data[lead + 1]
        good = (after != 0x97) & (after != 0xB7)                 # U+00D7 and U+00F7 are no letters
        lead, after = lead[good], after[good]
        kind[lead] = kind[lead + 1] = 1
        low[lead[after < 0x9F] + 1] += 32
        bad = kind == 4
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)        # <| may begin a special token
        odd = np.zeros(len(off) - 1, bool)
        odd[np.searchsorted(off, np.flatnonzero(bad), side="right") - 1] = True
        kind[np.repeat(odd, np.diff(off))] = 0
        full = kind != 0
        new = full & (kind == 2)
        new[1:] |= full[1:] & (kind[1:] != kind[:-1])
        new[off[:-1][np.diff(off) > 0]] |= full[off[:-1][np.diff(off) > 0]]
        start = np.flatnonzero(new)
        place = np.cumsum(full) - 1                              # among the bytes that are kept
        ends = np.append(place[start], full.sum()).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(low[full]))
        enc = pieces.dictionary_encode()
        get = self.place.get
        at = np.empty(len(enc.dictionary), np.int64)
        for i, p in enumerate(enc.dictionary.to_pylist()):
            k = get(p)
            at[i] = self._piece_place(p) if k is None else k
        begin = np.array(self.begin, np.int64)
        at = at[np.asarray(enc.indices, np.int64)] if len(start) else np.empty(0, np.int64)
        count = begin[at + 1] - begin[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = np.array(self.flat, np.uint32)[ragged(begin[at], count)]
        return ~odd, ids, np.diff(total[np.searchsorted(start, off)])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of each row); null and empty texts have none."""
        col = pc.fill_null(col, "")
        if self.by_word:
            if len(self.place) + len(self.known) > self.most:
                self._clear()
            ok, ids, count = self._fast(*text_buffer(col))
            if ok.all():
                return ids, np.concatenate([[0], np.cumsum(count)])
            rest = np.flatnonzero(~ok)
            more, off = self._chunks(col.take(pa.array(rest)))
            count[rest] = np.diff(off)
            off = np.concatenate([[0], np.cumsum(count)])
            out = np.empty(off[-1], np.uint32)
            out[ragged(off[:-1][ok], count[ok])] = ids
            out[ragged(off[:-1][rest], count[rest])] = more
            return out, off
        return self._chunks(col)

    def _chunks(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            ids = [e.ids for e in self.tok.encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
            n = np.array([0, *map(len, ids)], np.int64)
            return np.array([i for x in ids for i in x], np.uint32), np.cumsum(n)
        words = pc.ascii_split_whitespace(col)
        first = np.asarray(words.offsets, np.int64)
        first = first - first[0]
        enc = words.flatten().dictionary_encode()
        if len(self.known) + len(self.place) > self.most:
            self._clear()
        get = self.known.get
        at = np.empty(len(enc.dictionary), np.int64)
        for i, c in enumerate(enc.dictionary.to_pylist()):
            if c:
                k = get(c)
                at[i] = self._chunk(c) if k is None else k
            else:
                at[i] = -1
        flat, begin = np.array(self.flat, np.uint32), np.array(self.begin, np.int64)
        begin = np.append(begin, begin[-1])            # entry -1: an empty chunk, no ids
        at[at < 0] = len(begin) - 2
        at = at[np.asarray(enc.indices, np.int64)] if len(enc) else np.empty(0, np.int64)
        count = begin[at + 1] - begin[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        return flat[ragged(begin[at], count)], ends[first]


def encode_rows(enc: Encoder, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode`` with ``end_id`` after the last id of each row."""
    ids, off = enc.encode(col)
    return np.insert(ids, off[1:], np.uint32(end_id)), off + np.arange(len(off))


