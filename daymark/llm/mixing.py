"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times. The whole part is taken; the
fractions are rounded in pairs: words are moved at random from one document to the other until one
of them is taken wholly or not at all, so the words of the source stay the same through every step
and, but for the last one of a source, each document keeps its expectation. A document too large for such steps is paired with all the rest
of its block at once. Blocks of a source are rounded side by side; what is left
of each block, at most one document, is rounded again block of blocks by block of blocks, until one
document a source remains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.parts import joined_by_parts
from daymark.llm.sift import Sift, fresh
from daymark.session import materialise

#: Documents of one block, and blocks joined at each level of the tree.
BLOCK_ROWS, FAN_IN = 4096, 256
#: Copies of a document's source that the mix takes at most.
MOST = 3.0
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = 1e-9


def targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row a source: ``rank``, ``rows``, ``source_size`` and ``target`` (double).

    Sources by code point, null last, weigh 1, 2, 3 and again. A target stops at ``MOST`` times the
    source's size; what is cut off goes to the others by weight, until none is above. In the order
    of size over weight the stopped sources come first, so running sums find the level at which the
    resharing ends. The windows see one row a source, so there may be as many sources as one task
    sorts (some 10^7): a source is a collection of documents, not a host or a page.
    """
    by_source = sized.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("rows"), F.sum(size).alias("source_size")
    )
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    every = Window.partitionBy(F.lit(0))
    lower = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    stop = MOST * F.col("source_size")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(stop).over(lower), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))
    )
    # The level counts from the first source, in that order, that it does not stop.
    free = ranked.withColumn("level", level).withColumn(
        "level", F.when(stop >= F.col("level") * F.col("weight"), F.col("level"))
    )
    final = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("source_size") / F.col("weight"))).over(every)
    return free.withColumn("target", F.least(stop, final * F.col("weight"))).select(
        "source", "rank", "rows", "source_size", "target"
    )


def round_pairs(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Shares rounded to 0 or 1 in the given order; the index of the one left over, or -1.

    Of a pair, ``t`` words move one way with the probability that keeps both expectations.
    """
    shares = shares.copy()
    held = -1
    for i in range(len(shares)):
        if shares[i] <= _EDGE or shares[i] >= 1 - _EDGE:
            shares[i] = round(shares[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        x, y = a * shares[held], b * shares[i]
        to_i, to_held = min(x, b - y), min(y, a - x)
        if draws[i] * (to_i + to_held) < to_held:
            x, y = x - to_i, y + to_i
        else:
            x, y = x + to_held, y - to_held
        pair = []
        for k, words in ((held, x), (i, y)):
            share = words / sizes[k]
            whole = share <= _EDGE or share >= 1 - _EDGE
            shares[k] = round(share) if whole else share
            if not whole:
                pair.append(k)
        held = pair[0] if pair else -1
    return shares, held


def settle_large(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> int:
    """Round the leading documents that the rest of the block could hardly absorb; return how many.

    ``sizes`` fall and ``shares`` are all the same. Such a document is paired with all the rest at
    once: it is taken or not with its own probability, and the words this adds or frees come evenly
    from the rest, which keeps every expectation as in a pair. ``shares`` is changed in place.
    """
    rest = sizes.sum() - np.cumsum(sizes)
    spread = (sizes**2).sum() - np.cumsum(sizes**2)
    for k in range(len(sizes) - 1):
        a, p, s = sizes[k], shares[k], rest[k]
        if not _EDGE < p < 1 - _EDGE or 9 * a * a <= spread[k] * p * (1 - p):
            return k
        taken = draws[k] < p
        after = p - a * (1 - p) / s if taken else p + a * p / s
        if not _EDGE < after < 1 - _EDGE:
            return k
        shares[k] = float(taken)
        shares[k + 1 :] = after
    return max(0, len(sizes) - 1)


def rounder(seed: int, level: int):
    """One block's ``share`` rounded; the row left over has it under ``left`` and a null ``share``."""

    def run(table: pa.Table) -> pa.Table:
        return round_block(table, seed, level)

    return run


def round_block(table: pa.Table, seed: int, level: int) -> pa.Table:
    order = [("size", "descending"), *((c, "ascending") for c in ("id", "number", "block") if c in table.column_names)]
    table = table.sort_by(order)
    sizes = table.column("size").to_numpy().astype(float)
    shares = table.column("share").to_numpy().astype(float)
    group = table.column("group")[0].as_py() if "group" in table.column_names else table.column("block")[0].as_py()
    rng = np.random.default_rng([seed, level, table.column("rank")[0].as_py(), group])
    draws = rng.random(len(sizes))
    empty = sizes <= 0
    shares[empty] = draws[empty] < shares[empty]
    filled = int((~empty).sum())
    # Only the first level has one share for the whole block.
    done = settle_large(sizes[:filled], shares[:filled], draws) if level == 0 else 0
    tail, held = round_pairs(sizes[done:], shares[done:], rng.random(len(sizes) - done))
    shares = np.concatenate((shares[:done], tail))
    held = held + done if held >= 0 else -1
    left = np.arange(len(shares)) == held
    at = table.column_names.index("share")
    table = table.set_column(at, "share", pa.array(shares, mask=left))
    return table.append_column("left", pa.array(shares, mask=~left))


def copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11
) -> DataFrame:
    """How often the mix takes each document: id, ``source``, ``size``, ``source_size``, ``target``, ``copies``.

    ``size`` is the number of words, 0 for a null text. The same rows and ``seed`` give the same
    result. A source without words has target 0 and its documents are not taken. Repeated rows
    are rounded one by one. Other columns are not looked at.
    """
    return _rounded(docs, F.col(id_column), F.lit(0), F.col(text), F.col(source), seed).select(
        F.col("id").alias(id_column), "source", "size", "source_size", "target", "copies"
    )


def _rounded(docs: DataFrame, identity: Column, number: Column, text: Column, source: Column, seed: int) -> DataFrame:
    """Rows ``id``, ``number`` with their ``copies``; ``number`` tells rows with one id apart."""
    spread = F.when(identity.isNotNull(), F.xxhash64(identity, F.lit("block"))).otherwise(F.xxhash64(text, F.lit("block")))
    sized = materialise(
        docs.select(
            identity.alias("id"),
            number.cast("long").alias("number"),
            spread.alias("spread"),
            source.cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )
    aims = materialise(targets(sized), "targets")
    # A source with many rows meets its target in parts.
    joined = joined_by_parts(sized, aims, "source", "rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = joined.withColumn("rate", rate).select(
        "id", "number", "source", "size", "source_size", "target",
        F.col("rank").cast("long").alias("rank"),
        F.floor("rate").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("share"),
        F.pmod("spread", F.ceil(F.col("rows") / BLOCK_ROWS)).alias("block"),
    )
    blocks = materialise(
        wanted.groupBy("rank", "block").applyInArrow(
            rounder(seed, 0),
            "id long, number long, source string, size long, source_size long, target double, rank long, whole long, "
            "share double, block long, left double",
        ),
        "blocks",
    )
    left = blocks.filter(F.col("left").isNotNull()).select("rank", "block", "size", F.col("left").alias("share"))
    span = aims.agg(F.max(F.ceil(F.col("rows") / BLOCK_ROWS))).first()[0] or 1
    settled, level, width = None, 0, 1
    while width < span:
        level, width = level + 1, width * FAN_IN
        group = left.withColumn("group", F.floor(F.col("block") / width).cast("long"))
        rounded = materialise(
            group.groupBy("rank", "group").applyInArrow(
                rounder(seed, level),
                "rank long, block long, size long, share double, group long, left double",
            ),
            "rounded",
        )
        done = rounded.filter(F.col("share").isNotNull()).select("rank", "block", "share")
        settled = done if settled is None else settled.unionByName(done)
        left = rounded.filter(F.col("left").isNotNull()).select(
            "rank", "block", "size", F.col("left").alias("share")
        )
    # At most one document a source is left; taking the nearer side keeps the source nearest to
    # its target.
    last = left.select("rank", "block", (F.col("share") >= 0.5).cast("double").alias("share"))
    settled = last if settled is None else settled.unionByName(last)
    settled = settled.withColumnRenamed("share", "settled")
    return blocks.join(settled, ["rank", "block"], "left").select(
        "id",
        "number",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.coalesce("share", "settled")).cast("long").alias("copies"),
    )


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", seed: int = 11, id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` with every row as often as :func:`copies` takes it; rows not taken go.

    A row is known by its id. Rows that share an id, or have none, are numbered in a written table, so
    each of them is rounded and repeated as itself, however much alike they are. Names that the
    work needs are chosen so that no column of ``docs`` is touched.
    """
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    number, times, of = (fresh(docs, c) for c in ("number", "times", "of"))
    identity = F.col("`" + id_column + "`").cast("long")
    shared = docs.groupBy(identity.alias(of)).count().filter((F.col("count") > 1) | F.col(of).isNull()).select(of)
    shared = materialise(shared, "shared-ids")
    # A null id hashes like any other value, so rows without one are among the unsure.
    alone, unsure = Sift(shared, F.col(of)).split(docs, identity)
    same = identity.eqNullSafe(F.col(of))
    alike = materialise(unsure.join(shared, same, "left_semi").withColumn(number, F.monotonically_increasing_id()), "alike")
    alone = alone.unionByName(unsure.join(shared, same, "left_anti")).withColumn(number, F.lit(-1).cast("long"))
    whole = alone.unionByName(alike)
    taken = _rounded(whole, identity, F.col(number), F.col(text), F.col(source), seed).filter("copies > 0")
    taken = taken.select("id", "number", F.col("copies").cast("int").alias(times))

    def repeated(rows: DataFrame, found: DataFrame, known) -> DataFrame:
        # One row a copy; the array has at most a few elements.
        joined = rows.join(found, known)
        return joined.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*names)

    one = taken.filter("number = -1").select(F.col("id").alias(of), times)
    many = taken.filter("number >= 0").select(F.col("number").alias(of), times)
    return repeated(alone, one, identity == F.col(of)).unionByName(repeated(alike, many, F.col(number) == F.col(of)))
