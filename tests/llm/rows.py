"""Rows that the tests of the training-data operators share."""

import random

SF = "/root/testdata/sf0.001"
#: a table with the columns of documents and some that clash with internal names
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, h long, bucket int, "
          "n_words string, tokens string, shard int")


def prose(seed, n, words=400):
    r = random.Random(seed)
    pool = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(r.choice(pool) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def messy_rows():
    """Nulls, empty and blank texts, odd characters, one long text, copies, near copies, shared passages."""
    passage, a, b = prose(1, 60), prose(2, 300), prose(3, 160)
    near = a.split(" ")
    near[100] = "changed"
    texts = [
        None, "", "   \n\t ", "one two", "one two", "one TWO", "x", a, a, a.upper(), " ".join(near), b + " " + passage,
        prose(4, 120) + " " + passage + " " + prose(5, 30), passage, prose(6, 80) + "\n" + "same line\n" * 9,
        "go go go go " * 40, "日本語 テキスト ßÀÿ́ é <|endoftext|> it's DON'T 12\x0b3\x85x\xa0y", prose(7, 6000, 3000),
        "Licensed under the Apache License, Version 2.0. GNU General Public License version 3; CC BY-NC; MIT license",
        "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\n" + prose(8, 60),
        prose(9, 100) + " cc by cc by", "#*$ %& " * 60, "THE END!! " * 5 + prose(10, 70), "aaaa" * 200, "aaaa" * 130 + "b",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, prose(11, 90)), (None, None), (7, a), (3, "one two"), (40, prose(12, 90)), (40, prose(12, 91))]
    return [(i, t, None if i and i % 7 == 0 else "en", None if i and i % 5 == 0 else "s", None, 1, 2, 3, "4", "5", 6)
            for i, t in rows]
