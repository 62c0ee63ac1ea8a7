"""How five text filters interact, counted over every order in which they can be applied.

*Fails.* DataFrame expressions find which filters a document fails, a mask of five bits. Copies of a
text are told by digest: rows are counted per (digest, part, mask, labels) before the rows of one
digest meet, so a text with very many copies never gathers in one task.

*Wide counters.* A mask stands for a big integer with one 64-bit field for each outcome of each step
of each order (120 orders, 5 steps, 6 outcomes); a field is 1 where a document of that mask has the
outcome. The counts of a part are the sum of its documents' integers, taken mask by mask as
(documents of the mask) x (its integer). A field never exceeds the number of documents, which is
below 2**63, so no field carries into the next one and the sum is taken apart without overflow.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter names in the order of their bits, and the outcomes of a step.
FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
BLANK, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FIELDS = (len(ORDERS), len(FILTERS), len(OUTCOMES))
FIELD_BYTES = 8
AUDITED = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))


@lru_cache(4 << len(FILTERS))
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The integer of a document that fails the filters of ``mask``."""
    fields = np.zeros(FIELDS, "<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = fails and not gone
            fields[o, s] = (
                not (gone or fails), removed, fails and gone, mask == bit, removed and good, removed and toxic,
            )
            gone = gone or fails
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by order, step and outcome."""
    return np.frombuffer(total.to_bytes(int(np.prod(FIELDS)) * FIELD_BYTES, "little"), "<u8").reshape(FIELDS)


def audited_part(table: pa.Table) -> pa.Table:
    """The 600 rows of one part from its counts: at most one row for each mask and pair of labels."""
    total = 0
    for mask, good, toxic, n in zip(*(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))):
        total += n * packed(mask, good, toxic)
    counts = unpacked(total).astype(np.int64)
    order, step = np.divmod(np.arange(counts[..., 0].size), len(FILTERS))
    removed = counts[..., OUTCOMES.index("removed")].ravel()
    letter = np.array([FILTERS.index(name) for names in ORDERS for name in names])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, letter, removed)
    part = table.column("part")[0].as_py()
    return pa.table(
        {
            "part": pa.array([part] * len(order), pa.string()),
            "filter_order": pa.array([ORDERS[o] for o in order]),
            "step": pa.array(step + 1, pa.int32()),
            **{name: pa.array(counts[..., k].ravel()) for k, name in enumerate(OUTCOMES)},
            "shapley": pa.array(shapley[letter]),
        }
    )


def text_fails(text: Column) -> Column:
    """Bits of the filters that look at one text; null is the empty text."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    size = F.size(words)
    tests = (
        size < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < size * DISTINCT_PERCENT,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        F.rlike(text, F.lit(SYMBOLS)),
    )
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))


def failures(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Documents counted: rows ``part``, ``mask``, ``good``, ``toxic`` and ``n``, at most 128 a part.

    A document is good (toxic) where any of its label rows has quality (toxic) 1. It repeats a text
    when the same text, null as the empty one, has a smaller id anywhere in the table; a row without
    an id repeats nothing and is repeated by nothing. Rows that share an id are documents each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_fails(body).alias("mask"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    marked = labels.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    ).filter("good or toxic")
    marked = marked.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(marked, "id", "left").select("id", "part", "mask", "digest", *flags)
    # The join has dealt rows by id, so this first count needs no exchange of its own.
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", *kinds).agg(F.count("*").alias("n"))
    first = F.struct(F.col("id").isNull().alias("loose"), "id", "n")
    by_kind = by_id.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.min(first).alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"),
    )
    # Rows of one digest are now one for each part and pair of labels.
    least = F.min("first.id").over(Window.partitionBy("digest"))
    fresh = F.col("loose") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    told = by_kind.withColumn("fresh", fresh)
    repeat = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")),
        F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
    )
    counted = told.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: see ``OUTCOMES``.

    ``part`` null is the empty string. ``kept`` pass every filter up to this step; ``removed`` fail
    this filter and none before; ``redundant`` fail it and one before; ``unique_fails`` fail this
    filter alone of all five; ``good_lost`` and ``toxic_lost`` are the removed with that label;
    ``shapley`` is the filter's removed summed over all orders. An empty table has no parts and gives
    no rows. Other columns are not looked at.
    """
    return failures(docs, labels, id_column, text, part).groupBy("part").applyInArrow(audited_part, AUDITED)
