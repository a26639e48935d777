"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str, spread: Column,
                 share: int = SHARE, hashed: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``keys``: one stored row for each key, with its number of rows in ``count``.

    A key with more than 1 / ``share`` of the counted rows is dealt out over as many salts as keep each
    below that, by the hash ``spread`` of the row. Fewer than ``share`` keys can be so frequent, whatever
    the data, so their list is broadcast; ``keys`` repeats them once for each salt (less than
    twice ``share`` more rows). ``count`` does not come with the result. ``hashed``: the keys of a partition are
    so few beside its rows that they are hashed and the rows need no sort.
    """
    total = keys.agg(F.sum(count)).first()[0] or 1
    salts = F.ceil(F.col(count) * F.lit(share) / F.lit(total)).cast("int")
    hot = keys.filter(salts > 1).select(*on, salts.alias("_salts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(spread, F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    dealt = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(count)
    return salted.join(dealt.hint("shuffle_hash") if hashed else dealt, [*on, "_salt"]).drop("_salt")
