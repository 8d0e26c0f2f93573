"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.session import written


def spread_join(fact: DataFrame, per_key: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a large ``fact`` to an aggregate of itself (``per_key``) on ``key``.

    Adaptive execution splits the rows of a hot key only where nothing stands between a join and the
    shuffles under it, and an aggregate would. So the aggregate is written to the shared folder and
    joined as a table: a small one is broadcast by its size, a large one by a shuffle whose skewed
    partitions are split.
    """
    return fact.join(written(per_key, "per-key"), list(key), how)


def small_table(df: DataFrame, max_rows: int) -> DataFrame | None:
    """A table of at most ``max_rows`` rows, ready to broadcast, or None when it is larger.

    The size is checked by reading one row more than allowed. The rows are kept as a local relation,
    so a plan that uses it several times does not compute it again.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
