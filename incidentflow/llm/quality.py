"""Operator 3 - quality rules as a short-circuit cascade, in DataFrame functions only.

Every row gets the base statistics of its whole text. The rules of the method then form one CASE
expression, which stops at the first rule that rejects. ``plan_cascade`` estimates on a
sample of at most ``sample_rows`` rows what each rule costs (characters that it reads) and how much it
rejects of what the rules before it let through, and orders the rules by rejection per cost; the order
changes the work, never the verdict.

Repeated words without a shuffle: each 3-word window is hashed, its position is put into the low
bits, and sorting the array brings equal windows together.

Cases: null or empty text: no words, so it fails the base rule. Texts of any length, repeated rows
and null ids are judged alone; an empty table gives an empty result. All columns are kept;
the result is added as one struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 500
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# --- fixed values: character classes of the contract ---
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"
PLAIN = r"[a-z.,\x20\x09-\x0D]+"          # what no rule counts: taken out of the text once


def _repeat_words(packed: Column, near: Column, low: Column, tri: Column) -> Column:
    """Words covered by 3-word windows found twice or more.

    ``tri``: hashes of the windows; ``packed``: sorted, their low bits (below ``low``, a power of two)
    replaced by the position, so that equal windows are neighbours; ``near``: places in ``packed``
    whose next entry has the same high bits.
    """
    def place(i):
        return F.get(packed, i).bitwiseAND(low - 1)

    both = F.transform(near, lambda i: F.when(
        F.get(tri, place(i).cast("int")) == F.get(tri, place(i + 1).cast("int")),
        F.array(place(i), place(i + 1))).otherwise(F.array().cast("array<bigint>")))
    starts = F.sort_array(F.array_distinct(F.flatten(both)))
    # a window adds at most 3 words beyond the repeated window before it
    return F.aggregate(starts, F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
                       lambda a, x: F.struct(x.alias("at"),
                                             (a["n"] + F.least(F.lit(3).cast("long"), x - a["at"])).alias("n")),
                       lambda a: a["n"])


def base_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the base columns (names with ``prefix``)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    p, none = prefix, F.array().cast("array<bigint>")
    df = docs.withColumns({f"{p}bare": F.btrim(text, F.lit(SPACES)),
                           f"{p}rest": F.regexp_replace(text, PLAIN, "")})
    bare, w = F.col(f"{p}bare"), F.col(f"{p}words")
    df = df.withColumn(f"{p}words", F.when(bare == "", F.array().cast("array<string>"))
                       .otherwise(F.split(bare, SPACE)))
    # each column that a lambda reads is a projection of its own, so it is computed once per row
    df = df.withColumns({f"{p}n_words": F.size(w).cast("long"),
                         f"{p}hash": F.transform(w, lambda x: F.xxhash64(x))})
    n, h = F.col(f"{p}n_words"), F.col(f"{p}hash")
    df = df.withColumn(f"{p}tri", F.when(n >= 3, F.transform(
        F.slice(h, 3, F.greatest(n - 2, F.lit(0)).cast("int")),
        lambda x, i: F.xxhash64(x, F.get(h, i), F.get(h, i + 1)))).otherwise(none))
    tri, low = F.col(f"{p}tri"), F.col(f"{p}low")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumns({f"{p}lines": lines,
                         f"{p}low": F.pow(F.lit(2), F.length(F.bin(F.size(tri).cast("long")))).cast("long")})
    # most texts have no window twice: nothing to sort
    df = df.withColumn(f"{p}packed", F.when(F.size(F.array_distinct(tri)) == F.size(tri), none).otherwise(
        F.sort_array(F.transform(tri, lambda x, i: x.bitwiseAND(-low).bitwiseOR(i.cast("long"))))))
    packed = F.col(f"{p}packed")
    df = df.withColumn(f"{p}near", F.when(F.size(packed) < 2, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.size(packed) - 2),
                 lambda i: F.get(packed, i).bitwiseXOR(F.get(packed, i + 1)).between(F.lit(0), low - 1))))
    return df.withColumns({
        f"{p}word_chars": F.length(F.array_join(w, "")).cast("long"),
        f"{p}n_symbols": F.length(F.regexp_replace(F.col(f"{p}rest"), NOT_SYMBOLS, "")).cast("long"),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        f"{p}n_repeat_words": _repeat_words(packed, F.col(f"{p}near"), low, tri),
    }).drop(*[f"{p}{x}" for x in ("bare", "words", "hash", "tri", "lines", "low", "packed", "near")])


def rules(prefix: str = "_q_") -> dict[str, tuple[Column, Column]]:
    """The method's rules: name -> (condition that rejects, characters that it reads). All comparisons are
    of exact integers."""
    c = {x: F.col(f"{prefix}{x}") for x in (*BASE, "n_lines")}
    rest, numbers = F.col(f"{prefix}rest"), F.lit(8).cast("long")
    reads = numbers + F.length(rest)

    def left(runs):
        return F.length(F.regexp_replace(rest, runs, ""))

    return {
        "symbols": (5 * c["n_symbols"] > c["n_words"], numbers),             # a symbol for five words
        "duplicate_lines": (100 * c["n_dup_lines"] > 50 * c["n_lines"], numbers),
        "word_length": ((c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"]), 2 * numbers),
        "capitals": (100 * left(r"[^A-ZÀ-ÖØ-Þ]+") > 50 * c["word_chars"], reads),
        "exclamations": (5 * (F.size(F.split(rest, "!", -1)) - 1) > c["n_words"], reads),
        "other_characters": (100 * left(r"[A-Za-z\u0080-\x{10FFFF}]+") > 50 * c["word_chars"], reads),
    }


def base_failed(prefix: str = "_q_") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * n)


def plan_cascade(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names in the order of rejection per cost on the table's first ``sample_rows`` rows.

    The cost of a rule on a row is the number of characters that it reads; each next rule is the one that
    rejects most per cost of the rows that the base and the rules before it let through. Verdicts and costs
    come from one job (no exchange), so the order is the same in every run over the same rows.
    """
    own = rules()
    sample = base_statistics(docs.select(F.col(f"`{text_col}`").alias("text")), "text").select(
        base_failed().alias("base"), F.array(*[r for r, _ in own.values()]).alias("rejects"),
        F.array(*[c for _, c in own.values()]).alias("cost")).take(sample_rows)
    rows, names, left = [r for r in sample if not r["base"]], list(own), list(range(len(own)))
    order = []
    while left:
        def gain(i):
            return sum(bool(r["rejects"][i]) for r in rows) / max(sum(r["cost"][i] for r in rows), 1)
        best = max(left, key=lambda i: (gain(i), -i))
        left.remove(best)
        order.append(names[best])
        rows = [r for r in rows if not r["rejects"][best]]
    return order


def quality_rules(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
                  into: str = "quality", order: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column: the base statistics, base_failed, kept, rule (that rejected, else null).

    ``rule`` depends on the order of the cascade; everything else does not.
    """
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    stats = base_statistics(docs, text_col)
    order = order or plan_cascade(docs, text_col, sample_rows)
    own, cascade = rules(), F.when(F.col("_q_failed"), F.lit("base"))
    for name in order:
        cascade = cascade.when(own[name][0], F.lit(name))
    judged = stats.withColumn("_q_failed", base_failed()).withColumn("_q_rule", cascade)
    result = F.struct(*[F.col(f"_q_{x}").alias(x) for x in BASE], F.col("_q_failed").alias("base_failed"),
                      F.col("_q_rule").isNull().alias("kept"), F.col("_q_rule").alias("rule"))
    # A filter on any field would be pushed below the projections, with every statistic copied into
    # it; an expression that is not deterministic (and always true) over the whole struct keeps it above them.
    return judged.withColumn(into, F.when(F.monotonically_increasing_id() >= 0, result)).drop(
        *[f"_q_{x}" for x in (*BASE, "n_lines", "rest", "failed", "rule")])
