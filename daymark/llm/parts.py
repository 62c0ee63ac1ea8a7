"""Joins of rows with one row a group, where a group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.sift import fresh

#: Rows of one part of a group, and the share of all rows (1 in so many) above which a group has parts:
#: at most so many groups are broadcast.
PART_ROWS, LARGE_GROUPS = 2000, 1 << 16


def joined_by_parts(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``groups``, which has one row for each value of ``key``.

    ``size`` is the column of ``groups`` that tells how many rows the group has. A large group is cut into
    parts, and its row is there once for each of them, so no task gets the whole of it. Nulls of ``key``
    are a group like any other. The columns of both sides, but for ``key``, have different names.
    """
    part, parts, of = fresh(rows, "part"), fresh(rows, "parts"), fresh(rows, "of")
    total = groups.agg(F.sum(size).alias("n")).scalar()
    large = groups.filter((F.col(size) > PART_ROWS) & (F.col(size) * LARGE_GROUPS > total)).select(
        F.col(key).alias(of), F.ceil(F.col(size) / PART_ROWS).cast("int").alias(parts)
    )
    count = F.coalesce(parts, F.lit(1))

    def cut(df: DataFrame, number: Column) -> DataFrame:
        # A broadcast of fewer than LARGE_GROUPS rows.
        return df.join(F.broadcast(large), F.col(key).eqNullSafe(F.col(of)), "left").withColumn(part, number).drop(of, parts)

    left = cut(rows, F.pmod(F.monotonically_increasing_id(), count).cast("int"))
    right = cut(groups, F.explode(F.sequence(F.lit(0), count - 1)))
    right = right.withColumnsRenamed({key: of, part: parts})
    same = F.col(key).eqNullSafe(F.col(of)) & (F.col(part) == F.col(parts))
    return left.join(right, same, how).drop(of, part, parts)
