"""Operator 1 - token counts of whole texts under a unigram vocabulary.

Count-only Viterbi: an Aho-Corasick automaton enumerates all vocabulary matches, and one pass of
dynamic programming carries the best score and the number of pieces. Tie rules are those of the
public unigram tokenizers: of equally good ways to reach a position the one whose last piece
starts first wins; a character that is no piece of its own may be an unknown of the lowest
score minus 10, counted as its UTF-8 bytes when the vocabulary has byte pieces (else as one).

Blanks become U+2581 with one put in front. No piece has that mark after another character, and
a character outside the vocabulary is always alone, so the best path never crosses the start of
a word; words are solved once per distinct word.

Cases: null or empty text: 0 tokens, score 0. Blanks only, repeated rows, ties and very long texts
need no special treatment. Rows are kept as they are, also with repeated or null ids; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import vocabulary_path
from .common import id_text, slices

PIECES = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0       # fixed value of the public unigram tokenizers


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, most: int = 250_000):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.alphabet = {c for p, _ in pieces for c in p}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback, self.most = byte_fallback, most
        self.split_lines = "\n" not in self.alphabet
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece crosses the start of a word")
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def load(cls, path: str) -> "UnigramCounter":
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path))
        ids = range(m.vocab_size())
        plain = [i for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in plain], sum(map(m.is_byte, ids)) == 256)

    def solve(self, w: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of ``w``."""
        n = len(w)
        best = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        if self.single.issuperset(w):
            for end, (size, score) in self.auto.iter(w):     # at one end: longest match first
                end += 1
                s = best[end - size] + score
                if s > best[end]:
                    best[end], count[end] = s, count[end - size] + 1
            return count[n], best[n]
        at = [[] for _ in range(n + 1)]
        for end, m in self.auto.iter(w):
            at[end + 1].append(m)
        for end in range(1, n + 1):
            for size, score in at[end]:
                s = best[end - size] + score
                if s > best[end]:
                    best[end], count[end] = s, count[end - size] + 1
            if w[end - 1] not in self.single:
                s = best[end - 1] + self.unknown
                if s > best[end]:
                    c = len(w[end - 1].encode()) if self.byte_fallback else 1
                    best[end], count[end] = s, count[end - 1] + c
        return count[n], best[n]

    def word(self, w: str) -> tuple[int, float]:
        k = self.known.get(w)
        if k is None:
            if self.split_lines and "\n" in w:
                parts = [self.word(p) for p in w.split("\n") if p]
                lines = w.count("\n")
                k = (sum(p[0] for p in parts) + lines, sum(p[1] for p in parts) + lines * self.unknown)
            else:
                k = self.solve(w)
            if len(self.known) > self.most:
                self.known.clear()
            self.known[w] = k
        return k

    def text(self, t: str) -> tuple[int, float]:
        """One text, word by word (runs of blanks included)."""
        if not t:
            return 0, 0.0
        words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + t.replace(" ", MARK))
        got = [self.word(w) for w in words]
        return sum(g[0] for g in got), sum(g[1] for g in got)

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts and scores of a column; texts with single blanks go by distinct words."""
        col = pc.fill_null(col, "")
        n, score = np.zeros(len(col), np.int64), np.zeros(len(col))
        odd = np.asarray(pc.or_(pc.match_substring_regex(col, "^ | $|  "), pc.match_substring(col, MARK)))
        for i in np.flatnonzero(odd):
            n[i], score[i] = self.text(col[int(i)].as_py())
        rows = np.flatnonzero(~odd & (np.asarray(pc.binary_length(col)) > 0))
        if len(rows):
            words = pc.split_pattern(col.take(pa.array(rows)), " ")
            first = np.asarray(words.offsets, np.int64)
            enc = words.flatten().dictionary_encode()
            got = [self.word(MARK + w) for w in enc.dictionary.to_pylist()]
            at, first = np.asarray(enc.indices, np.int64), first - first[0]
            for out, k in ((n, 0), (score, 1)):
                value = np.array([g[k] for g in got])[at]
                out[rows] = np.add.reduceat(value, first[:-1])
        return n, score


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = PIECES) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, n_tokens, score (of the best path). No shuffle."""
    def run(batches):
        counter = UnigramCounter.load(vocabulary)
        for whole in batches:
            for b in slices(whole):
                n, score = counter.column(b.column("text"))
                chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), chars, pa.array(n), pa.array(score)],
                                                 names=["id", "n_chars", "n_tokens", "score"])

    src = id_text(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_chars long, n_tokens long, score double")
    return out.withColumnRenamed("id", id_col)
