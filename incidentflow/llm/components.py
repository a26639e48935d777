"""Connected components of a table of edges, by rounds of smallest labels and pointer jumping.

Every round each vertex takes the smallest label among its neighbours' and then the label of that
label; tables go through the shared folder between rounds (lineage cut). Degrees do not
matter: labels are combined by partial aggregation. Nothing but one count per round reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b): c is the smallest vertex reachable from v."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both.filter("a <> b").distinct(), f"{name}-edges")
    now = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c"))
                       .withColumnRenamed("a", "v"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = (both.join(now.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
                .withColumnRenamed("a", "v"))
        step = now.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # the label of the label: a label is a vertex, and its own label is never larger
        up = now.select(F.col("v").alias("c"), F.col("c").alias("up"))
        new = step.join(up, "c", "left").select("v", "old", F.least("c", "up").alias("c"))
        new = scratch.save(new, f"{name}-{turn}")
        changed = new.filter("c <> old").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        now = new.select("v", "c")
        if not changed:
            scratch.drop(f"{name}-edges")
            return now
