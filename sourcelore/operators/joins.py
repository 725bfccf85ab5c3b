"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table with few rows per key to rows whose keys may be very uneven.

    A table that was just grouped by the same keys is already partitioned by them, and a
    plain equality would reuse that partitioning. Spark can then neither split a hot key at
    run time nor turn the join into a broadcast once the table's real size is known: both
    need a fresh shuffle on each side. Null-safe equality compares expressions over the keys,
    so the (small) table is shuffled once more; and as it implies no filter on the inputs,
    an input that feeds several joins stays the same in all of them and is shuffled once.
    """
    fresh = table.select(*[F.col(key).alias(f"_{key}") for key in keys], *[c for c in table.columns if c not in keys])
    condition = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    return rows.join(fresh, condition, how).drop(*[f"_{key}" for key in keys])
