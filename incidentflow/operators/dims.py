"""Small-side joins with a checked size.

A dimension derived from a large table (centroids, ranked junction lists,
duration baselines) has no usable size estimate at plan time, so the planner
would shuffle both sides. ``materialise`` writes such a table once to the
shared checkpoint folder (cutting lineage, surviving executor loss) and reads
it back, so its true size is known; ``join_dim`` then broadcasts it only when
that size is under the broadcast threshold and otherwise falls back to an
ordinary shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Optimizer size estimate; exact file size for a materialised table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's own broadcast threshold; -1 (off) means that nothing is broadcast."""
    conf = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30}
    return int(conf[:-1]) << units[conf[-1]] if conf[-1:] in units else int(conf)


def join_dim(big: DataFrame, dim: DataFrame, on, how: str = "left", name: str = "dim") -> DataFrame:
    """Join a dimension with a checked size.

    1. the optimizer's estimate is under the limit -> broadcast;
    2. else the dimension is written once to the shared folder and its real
       size read back -> broadcast if under the limit;
    3. else an ordinary shuffled join on the written copy.
    """
    limit = broadcast_limit(dim)
    if size_in_bytes(dim) <= limit:
        return big.join(F.broadcast(dim), on, how)
    dim = materialise(dim, name)
    if size_in_bytes(dim) <= limit:
        return big.join(F.broadcast(dim), on, how)
    return big.join(dim, on, how)


def sized(df: DataFrame, name: str = "dim") -> DataFrame:
    """``df`` itself when its estimate is under the broadcast limit, else a written copy
    (exact size, lineage cut) - for a small table that several joins will read."""
    return df if size_in_bytes(df) <= broadcast_limit(df) else materialise(df, name)
