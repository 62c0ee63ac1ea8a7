"""Exact quantiles of groups of any size.

A sort or a list of a group's values does not survive a group that holds a third of all rows. Here
every step is an aggregate with a map-side combine: a mergeable summary (``percentile_approx``) puts a
bracket around the wanted rank of every group, a count tells how many values lie below and inside,
and the bracket is narrowed the same way until it holds few distinct values. Those are counted, and
the values at the rank are read off. A bracket that a count does not confirm is not taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.session import materialise

#: Distinct values of a bracket that one task may sort; steps and accuracy of a summary.
BRACKET_VALUES, STEPS, ACCURACY = 65_536, 256, 4_096


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float = 0.5,
    name: str = "quantile",
    bracket_values: int = BRACKET_VALUES,
    steps: int = STEPS,
) -> DataFrame:
    """One row a group: ``keys``, ``n`` (values that are not null) and the quantile as ``name``.

    The quantile lies at rank (n - 1) * ``share``, between two values in proportion. Groups without
    a value have n 0 and a null quantile. NaN counts as the largest value. A null key is a group.
    """
    if not 0.0 <= share <= 1.0:
        raise ValueError("a share lies between 0 and 1")
    if steps < 2 or bracket_values < 1:
        raise ValueError("a summary has at least two steps, a bracket at least one value")
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(a) for k, a in zip(keys, named)], F.col(value).cast("double").alias("v")
    )
    totals = rows.groupBy(*named).agg(F.count("v").alias("n"))
    rank = (F.col("n") - 1) * F.lit(float(share))
    # Ranks from zero; rows below the bracket, and rows and distinct values inside it.
    state = totals.select(
        *named,
        "n",
        F.floor(rank).alias("first"),
        F.ceil(rank).alias("second"),
        F.lit(float("-inf")).alias("lo"),
        F.lit(float("nan")).alias("hi"),
        F.lit(0).cast("bigint").alias("below"),
        F.col("n").alias("inside"),
    )
    state = materialise(state, "brackets")
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    while True:
        within = _within(rows, state, named)
        summary = within.groupBy(*named).agg(
            F.percentile_approx("v", grid, ACCURACY).alias("marks"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
        )
        # One step, and the summary's error, outwards on either side.
        spare = 1 + -(-steps // ACCURACY)
        left = F.floor((F.col("first") - F.col("below")) * steps / F.col("inside")).cast("int") - spare
        right = F.ceil((F.col("second") - F.col("below") + 1) * steps / F.col("inside")).cast("int") + spare
        guess = _matched(state, summary, named).select(
            *[F.col(f"s.{c}").alias(c) for c in state.columns],
            F.when(left > 0, F.get("marks", left)).otherwise(F.col("least")).alias("lo2"),
            F.when(right < steps, F.get("marks", right)).otherwise(F.col("most")).alias("hi2"),
        )
        guess = materialise(guess, "guesses")
        counted = _within(rows, guess, named, ("lo2", "hi2")).groupBy(*named).agg(
            F.count_if(F.col("v") < F.col("lo2")).alias("under"),
            F.count_if((F.col("v") >= F.col("lo2")) & (F.col("v") <= F.col("hi2"))).alias("held"),
        )
        sure = (F.col("below") + F.col("under") <= F.col("first")) & (
            F.col("below") + F.col("under") + F.col("held") > F.col("second")
        )
        after = _matched(guess, counted, named).select(
            *[F.col(f"s.{c}").alias(c) for c in (*named, "n", "first", "second")],
            F.when(sure, F.col("lo2")).otherwise(F.col("lo")).alias("lo"),
            F.when(sure, F.col("hi2")).otherwise(F.col("hi")).alias("hi"),
            F.when(sure, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"),
            F.when(sure, F.col("held")).otherwise(F.col("inside")).alias("inside"),
        )
        before, state = state, materialise(after, "brackets")
        widest, held = state.agg(F.max("inside"), F.sum("inside")).first()
        # Equal values do not narrow any further, however many they are.
        if (widest or 0) <= bracket_values or held == before.agg(F.sum("inside")).first()[0]:
            break
    counts = _within(rows, state, named).groupBy(*named, "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*named).orderBy("v")
    ends = _matched(state, counts, named).select(
        *[F.col(f"s.{c}").alias(c) for c in (*named, "first", "second", "below")],
        "v",
        F.col("c").alias("c"),
    )
    ends = ends.withColumn("end", F.col("below") + F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))

    def at(rank: str):
        return F.max(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end")), F.col("v")))

    found = ends.groupBy(*named).agg(at("first").alias("a"), at("second").alias("b"))
    part = F.col("s.n") - 1
    part = part * F.lit(float(share)) - F.floor(part * F.lit(float(share)))
    # Equal ends are not subtracted: infinity less infinity is no number.
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    state = totals.select(*named, "n")
    return _matched(state, found, named, "left").select(
        *[F.col(f"s.{a}").alias(k) for k, a in zip(keys, named)], F.col("s.n").alias("n"), between.alias(name)
    )


def _matched(state: DataFrame, other: DataFrame, named: Sequence[str], how: str = "inner") -> DataFrame:
    """One row a group on either side, null keys too."""
    same = F.lit(True)
    for k in named:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}"))
    return state.alias("s").join(other.alias("o"), same, how)


def _within(rows: DataFrame, state: DataFrame, named: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Rows inside their group's bracket. The state has a row a group; adaptive execution picks the join."""
    same = F.lit(True)
    for k in named:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    inside = (F.col("r.v") >= F.col("s.lo")) & (F.col("r.v") <= F.col("s.hi"))
    return rows.alias("r").join(state.alias("s"), same & inside).select(
        *[F.col(f"r.{k}").alias(k) for k in named], F.col("r.v").alias("v"), *[F.col(f"s.{c}").alias(c) for c in extra]
    )
