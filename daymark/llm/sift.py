"""Telling most rows apart from those that must be joined, so that their texts are not shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each row held, and the fewest and most bits of a filter (2 MB to 32 MB are broadcast).
BITS_A_ROW, FEWEST, MOST = 16, 1 << 24, 1 << 28
_PIECE = 1 << 16


class Sift:
    """Bits at the hashes of some rows: a row without its bit is not among them, others may be.

    The size follows the number of rows held, up to ``MOST`` bits. A filter that is too small for its
    rows lets more rows through, which costs time and changes no result.
    """

    def __init__(self, rows: DataFrame, *columns: Column):
        held = rows.select(F.xxhash64(*columns).alias("h"))
        count = held.count()
        self.bits = FEWEST
        while self.bits < min(MOST, BITS_A_ROW * count):
            self.bits *= 2
        spot = F.pmod("h", F.lit(self.bits))
        pieces = held.select(F.floor(spot / _PIECE).cast("int").alias("piece"), (spot % _PIECE).cast("int").alias("at"))

        def fill(table: pa.Table) -> pa.Table:
            bits = np.zeros(_PIECE, np.uint8)
            bits[table.column("at").to_numpy()] = 1
            return pa.table({"piece": table.column("piece").slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        # Distinct spots first: a row that is there very often is one spot.
        packed = pieces.distinct().groupBy("piece").applyInArrow(fill, "piece int, bits binary")
        self.words = np.zeros(self.bits // 8, np.uint8)
        for piece, bits in packed.collect():
            start = piece * _PIECE // 8
            self.words[start : start + _PIECE // 8] = np.frombuffer(bits, np.uint8)

    def spot(self, *columns: Column) -> Column:
        """Where a row's bit is."""
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def _marked(self, docs: DataFrame, columns: tuple[Column, ...], name: str) -> DataFrame:
        words = self.words

        @F.pandas_udf("boolean")
        def held(spots: pd.Series) -> pd.Series:
            return pd.Series(bits_at(words, spots.to_numpy()))

        return docs.withColumn(name, held(self.spot(*columns)))

    def split(self, docs: DataFrame, *columns: Column) -> tuple[DataFrame, DataFrame]:
        """Rows of ``docs`` that are surely not held, and the others."""
        name = fresh(docs, "held")
        marked = self._marked(docs, columns, name)
        return marked.filter(~F.col(name)).drop(name), marked.filter(F.col(name)).drop(name)

    def kept(self, docs: DataFrame, *columns: Column) -> DataFrame:
        """Rows of ``docs`` that may be held."""
        return self.split(docs, *columns)[1]


def bits_at(words: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """For each spot, whether its bit is set."""
    return (words[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"
