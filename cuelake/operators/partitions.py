"""Partitions in proportion to the data, for steps that hold much more in memory than they read.

Adaptive execution judges partitions by their compressed bytes and draws them together until few are left; windows and
sorts over texts that compress well then hold gigabytes a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def spread(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """``rows`` by ``key`` in so many partitions that each holds some ``most`` of the weight; a single key isn't divided."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, math.ceil(total / most)), key)
