"""Helpers shared by the text operators: row streams over Arrow, hashed text features, sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import small_batches

#: Rows turned into Python objects at once, so that a batch of long texts stays small.
SLICE = 128

_MULTIPLIER = np.uint32(2654435761)
_WORD_BASE = 0x9E3779B97F4A7C15 | 1


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def collected_rows(table: pa.Table, *names: str) -> list[tuple]:
    """Rows of a small collected table; lists come as numpy arrays."""
    columns = [table.column(n) for n in names]
    return [tuple(np.asarray(v.values) if isinstance(v, pa.ListScalar) else v.as_py() for v in row) for row in zip(*columns)]


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def fold(id_column: str, modulus: int) -> Column:
    """The remainder that keeps rows out of training: crc32 of the id as text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def smallest_hashes(labels: DataFrame, id_column: str, label: str, rows: int) -> list:
    """At most ``rows`` labelled ids, the same ones on every run: those of smallest hash.

    Several labels of one id count as the largest of them.
    """
    once = labels.groupBy(id_column).agg(F.max(label).alias(label))
    order = F.xxhash64(F.col(id_column), F.lit("fit"))
    return once.orderBy(order, id_column).limit(rows).collect()


def sum_counts(counts: DataFrame, size: int) -> np.ndarray:
    """Counts summed by code into a dense array; ``size`` bounds what reaches the driver."""
    total = np.zeros(size)
    summed = counts.groupBy("code").agg(F.sum("n").alias("n"))
    for row in summed.toArrow().to_batches():
        total[row.column("code").to_numpy()] = row.column("n").to_numpy()
    return total


def count_rows(counts: np.ndarray) -> pa.RecordBatch:
    """One task's counts as (code, n) rows, zeros left out."""
    code = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(code, pa.int64()), pa.array(counts[code].astype(np.int64))], ["code", "n"]
    )


@cache
def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


@cache
def space_table() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), np.bool_, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches where ``mask`` holds."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[0::2], edges[1::2]


def gram_codes(points: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order the hashed codes of all character n-grams, in text order."""
    found = []
    mixed = np.full(len(points), 0x9E37, np.uint32)
    for k in range(max(orders)):
        mixed = mixed[: max(0, len(points) - k)]
        mixed = (mixed ^ points[k:]) * _MULTIPLIER
        mixed ^= mixed >> np.uint32(15)
        if k + 1 in orders:
            found.append((mixed * np.uint32(0x01000193 + 2 * k)) >> np.uint32(32 - bits))
    return found


class Powers:
    """Powers of the word-hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, 2 * len(self.up))
            up = np.full(size, _WORD_BASE, np.uint64)
            down = np.full(size, pow(_WORD_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)


_POWERS = Powers()


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end), whatever their position in the text."""
    if not len(starts):
        return np.empty(0, np.uint64)
    _POWERS.grow(len(points) + 1)
    summed = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(points)], out=summed[1:])
    mixed = (summed[ends] - summed[starts]) * _POWERS.down[starts]
    return mix64(mixed)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    if not len(codes):
        return codes, np.empty(0, np.int64)
    # Codes of 16 bits sort by radix, which is several times faster.
    ordered = np.sort(codes.astype(np.uint16) if codes.max() < 65536 else codes, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first].astype(np.int64), np.diff(first, append=len(ordered))


#: Bits of a filter of hashes; its size is fixed, whatever it holds.
FILTER_BITS = 1 << 24


def spot_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def spot_bits(rows: DataFrame, spot: Column) -> np.ndarray:
    """Bits at the spots of all rows: ``FILTER_BITS`` / 32 words at most reach the driver."""
    words = (
        rows.select(spot.alias("s")).select(F.floor(F.col("s") / 32).alias("w"), (F.col("s") % 32).cast("int").alias("s"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("bits"))
    )
    table = words.toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    return bits


def holds(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bits[spots >> 5] >> (spots & 31).astype(np.uint32)) & 1 == 1


def told_apart(docs: DataFrame, spot: Column, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that the filter does not hold, and rows that it may hold.

    Only the second need a join, so the texts of the others are not shuffled. A full filter sends all
    rows there, which costs time and changes no result.
    """

    @F.pandas_udf("boolean")
    def held(spots: pd.Series) -> pd.Series:
        return pd.Series(holds(bits, spots.to_numpy()))

    marked = docs.withColumn("__held", held(spot))
    return marked.filter(~F.col("__held")).drop("__held"), marked.filter("__held").drop("__held")


def map_rows(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """``function`` turns an iterator of small Arrow batches into an iterator of column lists."""
    small_batches(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches):
        for columns in function(slices(batches)):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)],
                names=out.names,
            )
        # A worker outlives its task; what Arrow keeps for later batches would stay beside the next task's.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def with_scores(
    docs: DataFrame, score: Callable, added: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add the columns ``added``, computed by ``score`` from each row's text.

    ``keep`` names the columns that stay (all by default); those called like an added one go.
    """
    extra = T._parse_datatype_string(added)
    names = {n.lower() for n in extra.names}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *extra.fields])
    # A text that is returned anyway is not sent to the workers twice.
    at = next((i for i, c in enumerate(kept) if c.lower() == text.lower()), len(kept))
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    if at == len(kept):
        quoted.append("`" + text.replace("`", "``") + "`")

    def rows(batches):
        for batch in batches:
            found = [score(v) for v in batch.column(at).to_pylist()]
            columns = list(zip(*found)) if found else [()] * len(names)
            yield [*batch.columns[: len(kept)], *columns]

    return map_rows(docs.select(*map(F.col, quoted)), rows, schema)
