"""Operator 6 - licence scans of whole texts.

An Aho-Corasick automaton over the lower-cased words (joined by one blank) finds notice phrases and
identifier tags; the expression after a tag (``SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH
Classpath-exception-2.0) AND BSD-3-Clause``) is parsed by a shunting-yard parser (WITH binds
closest, then AND, then OR) and evaluated to two sets of labels: those that it names, and those that hold whichever
side of an OR is taken (``required``: AND unites its sides, OR keeps what they share).

Base labels come from four phrases; the method adds labels of further phrases and of expressions.
``score``: 1 for a valid expression, 0.9 for a phrase with a version or a licence's own wording,
0.8 for another phrase, 0.5 if a tag's expression is not valid, else 0; the largest counts.

Cases: null or empty text: no words, no labels, score 0, null positions. Texts of any length, repeated
rows and null ids are scanned as they are; overlapping places all count; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, id_text, slices, text_buffer

# --- fixed values: base phrases, and the method's own phrases, tags and identifier families ---
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PHRASES = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0", "mozilla public license": "mpl", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "creative commons zero": "cc0",
    "creative commons attribution": "cc-by", "all rights reserved": "all-rights-reserved",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAGS = ("spdx license identifier",)
TAG_LINE = r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)"
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"),
            ("mpl", "mpl"), ("epl", "epl"), ("cc0", "cc0"))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def rpn(expression: str) -> list[str] | None:
    """Reverse Polish form of a licence expression, by the shunting-yard method; None if not valid."""
    out, ops, operand = [], [], True                 # operand: an identifier or ( must come next
    for t in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif t in PRECEDENCE:
            if operand:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = True
        else:
            if not operand or not re.fullmatch(r"[a-z0-9][a-z0-9.+:-]*", t):
                return None
            out.append(t)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def _united(one: set, other: set) -> set:
    """Union, written into the larger set."""
    small, large = sorted((one, other), key=len)
    large |= small
    return large


def evaluate(expression: str) -> tuple[set[str], set[str]] | None:
    """(labels named, labels required) of an expression: identifier and family of licences; None if not valid.

    Both sides of AND are required, of OR what its sides share; WITH requires the licence and
    ``licence with exception``.
    """
    order = rpn(expression)
    if order is None:
        return None
    stack: list[tuple[str, set[str], set[str]]] = []
    for t in order:
        if t == "with":
            exception, licence = stack.pop(), stack.pop()
            if not licence[0] or not exception[0]:
                return None                           # WITH joins two plain identifiers
            own = licence[1] | {f"{licence[0]} with {exception[0]}"}
            stack.append(("", own, set(own)))
        elif t in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(("", _united(left[1], right[1]), left[2] & right[2] if t == "or" else _united(left[2], right[2])))
        else:
            own = {t} | {f for p, f in FAMILIES if t == p or t.startswith(p + "-")}
            stack.append((t, own, set(own)))
    return stack[0][1:]


def _automaton():
    import ahocorasick
    auto = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for p, label in BASE.items():
        kinds.setdefault(p, []).append(("base", label))
    for p, label in PHRASES.items():
        kinds.setdefault(p, []).append(("phrase", label))
    for p in TAGS:
        kinds.setdefault(p, []).append(("tag", ""))
    for p, v in kinds.items():
        auto.add_word(f" {p} ", (len(p) + 2, v))
    auto.make_automaton()
    return auto


def _strong(phrase_words: int, label: str) -> float:
    return 0.9 if phrase_words > 4 or label[-1:].isdigit() else 0.8


def scan_text(auto, words: bytes, raw: str) -> tuple:
    """(places as (word, base label), labels of the method, labels that expressions require, score) of one text.

    ``words``: its lower-cased words, each followed by one blank, one blank in front.
    """
    base, extra, required, score = [], set(), set(), 0.0
    text, tagged, seen, count = words.decode("utf-8"), False, 0, 0
    for end, (size, kinds) in auto.iter(text):
        at = end - size + 1                             # place of the blank before the first word
        if at >= seen:
            count += text.count(" ", seen, at)
            seen, word = at, count
        else:
            word = count - text.count(" ", at, seen)
        for kind, label in kinds:
            if kind == "base":
                base.append((word, label))
                score = max(score, 0.8)
            elif kind == "phrase":
                extra.add(label)
                score = max(score, _strong(size and text.count(" ", at, end), label))
            else:
                tagged = True
    if tagged:
        for m in re.finditer(TAG_LINE, raw.lower()):
            got = evaluate(re.sub(r"[\s*/#>-]+$", "", m[1]))
            if got:
                extra |= got[0]
                required |= got[1]
            score = max(score, 1.0 if got else 0.5)
    return base, extra, required, score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels,
    required (labels that hold under every choice of the text's valid expressions), score, places (array of word and
    label of the base phrases). No shuffle."""
    src = id_text(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        word, lower = ALNUM
        table = bytes(int(lower[b]) if word[b] else 32 for b in range(256))
        auto = _automaton()
        place = pa.struct([("word", pa.int64()), ("label", pa.string())])
        for whole in batches:
            for b in slices(whole):
                data, off = text_buffer(b.column("text"))
                data, cols = data.tobytes(), [[] for _ in range(9)]
                for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
                    raw = data[lo:hi]
                    words = raw.translate(table).split()
                    base, extra, required, score = scan_text(auto, b" " + b" ".join(words) + b" ", raw.decode())
                    own, at = {x for _, x in base}, [w for w, _ in base]
                    for c, v in zip(cols, (len(words), len(base), min(at, default=None), max(at, default=None),
                                           ",".join(sorted(own)), ",".join(sorted(own | extra)),
                                           ",".join(sorted(required)), score,
                                           [{"word": w, "label": x} for w, x in sorted(base)])):
                        c.append(v)
                types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64(), pa.list_(place)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "required", "score",
                           "places"])

    out = src.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, "
                              "base_labels string, labels string, required string, score double, "
                              "places array<struct<word: long, label: string>>")
    return out.withColumnRenamed("id", id_col)


