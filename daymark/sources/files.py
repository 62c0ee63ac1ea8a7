"""Readers for landed series files.

Every reader returns ``date`` plus value columns. Nothing is inferred from the data: CSV columns
are read as text and picked by header name, so extra vendor columns are never parsed, and JSON
has a declared schema. Downloading files is not Spark work and stays outside.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.functions import scalars as S

# Document shapes.
OBSERVATIONS_SCHEMA = "observations array<struct<date: string, value: string>>"
TIMELINE_SCHEMA = (
    "interest_over_time struct<timeline_data: array<struct<"
    "timestamp: string, values: array<struct<extracted_value: double>>>>>"
)


#: A landed folder of this name holds the documents of one year.
YEAR_FOLDER = re.compile(r"/year=(\d{1,4})(?=/)")
Dates = tuple[dt.date | None, dt.date | None]

#: Texts that stand for a missing value.
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A", "-NaN", "-nan", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a source has no rows. Looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def in_range(df: DataFrame, dates: Dates | None) -> DataFrame:
    """Rows whose ``date`` lies in the inclusive range; an open end is None."""
    first, last = dates or (None, None)
    if first is not None:
        df = df.filter(F.col("date") >= F.lit(first))
    if last is not None:
        # The last day counts to its end, as a date may have a time of day.
        df = df.filter(F.col("date") < F.lit(last + dt.timedelta(days=1)))
    return df


def _year_holds(year: int, dates: Dates | None) -> bool:
    first, last = dates or (None, None)
    return (first is None or first.year <= year) and (last is None or year <= last.year)


def _folder(path: str) -> str:
    """Folder of a file, written the same way whoever lists it."""
    return re.sub(r"^file:/+", "file:/", unquote(path)).rpartition("/")[0]


def _headers(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """First line of each file, found in one job; a folder's name leads to it."""
    lines = spark.read.text(list(files)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value"),
        F.monotonically_increasing_id().alias("at"),
    )
    # A file's first line is the first one of the block that starts it.
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    return {_folder(row.path): row.header for row in first.collect()}


def read_csv_series(
    spark: SparkSession,
    path: str | Sequence[str],
    date_col: str,
    value_col: str,
    name: str,
    sep: str = ",",
    fold_case: bool = False,
    keys: Sequence[str] = (),
    dates: Dates | None = None,
) -> DataFrame:
    """A delimited series with a header: ``keys``, ``date`` and the value as ``name``.

    Columns are found by name in the header of each folder, so folders may order them differently. A
    file whose header differs from its folder's is an error, not a misread column. ``MISSING`` tokens
    are null; any other text that is no number is an error. Folders with the same header are read
    together, so the plan has a branch for each header, not for each folder. With ``dates`` folders
    called ``year=`` that lie outside the range are not opened.
    """
    folders: dict[str, list[str]] = {}
    for file in spark.read.text(path).inputFiles():
        year = YEAR_FOLDER.search(file)
        if year is None or _year_holds(int(year[1]), dates):
            folders.setdefault(_folder(file), []).append(file)
    if not folders:
        raise ValueError(f"no file at {path}")
    found = _headers(spark, [min(same) for same in folders.values()])
    alike: dict[str, list[str]] = {}
    for folder, same in folders.items():
        alike.setdefault(found.get(folder, folder), []).extend(same)
    parts = []
    for same in alike.values():
        header = spark.read.option("header", True).option("sep", sep).csv(min(same)).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(same)
        if fold_case:
            raw = lower_names(raw)
        value = F.trim(F.col(value_col))
        number = F.when(~value.isin(*MISSING), value).cast("double")
        parts.append(raw.select(*keys, S.parse_date(F.col(date_col)).alias("date"), S.null_if_nan(number).alias(name)))
    return in_range(reduce(DataFrame.unionByName, parts), dates)


def read_price_csv(
    spark: SparkSession, path, name: str = "price", keys: Sequence[str] = (), dates: Dates | None = None
) -> DataFrame:
    """Comma-separated price history with ``Date`` and ``Close`` columns."""
    return read_csv_series(spark, path, "Date", "Close", name, keys=keys, dates=dates)


def read_fx_csv(
    spark: SparkSession, path, name: str = "fx", keys: Sequence[str] = (), dates: Dates | None = None
) -> DataFrame:
    """Semicolon-separated rate history whose headers come in any case."""
    return read_csv_series(spark, path, "date", "close", name, sep=";", fold_case=True, keys=keys, dates=dates)


def _documents(spark: SparkSession, path, schema: str, multi_line: bool, dates: Dates | None) -> DataFrame:
    """Landed documents; those in a ``year=`` folder outside ``dates`` are never opened."""
    options = {"multiLine": multi_line, "mode": "FAILFAST"}
    if dates is None or not any(YEAR_FOLDER.search(f) for f in spark.read.text(path).inputFiles()):
        return spark.read.schema(schema).json(path, **options)
    first, last = dates
    found = spark.read.schema(f"{schema}, year int").json(path, **options)
    # A filter of a partition column: the folders are left out before any task is planned.
    if first is not None:
        found = found.filter(F.col("year") >= first.year)
    if last is not None:
        found = found.filter(F.col("year") <= last.year)
    return found


def read_observations_json(
    spark: SparkSession, path, name: str = "rate", multi_line: bool = True, dates: Dates | None = None
) -> DataFrame:
    """``observations[]`` documents; a value that is not a number becomes null.

    A document that is cut off or has no ``observations`` is an error.

    ``multi_line=False`` reads one document per line, which Spark can split between tasks. ``dates`` is
    the range asked for: documents landed in folders called ``year=`` are skipped by it, rows always.
    """
    documents = _documents(spark, path, OBSERVATIONS_SCHEMA, multi_line, dates)
    observations = F.when(F.col("observations").isNotNull(), F.col("observations")).otherwise(
        F.raise_error(F.lit("a document has no observations"))
    )
    rows = documents.select(F.inline(observations)).select(
        S.parse_date(F.col("date")).alias("date"), S.parse_number(F.col("value")).alias(name)
    )
    return in_range(rows, dates)


def read_timeline_json(
    spark: SparkSession,
    path,
    names: Sequence[str] = ("trend_a", "trend_b"),
    multi_line: bool = True,
    dates: Dates | None = None,
) -> DataFrame:
    """Nested weekly timeline; entry ``i`` of ``values`` is the series ``names[i]``.

    A document without the timeline gives no rows; one that is cut off is an error. ``date`` keeps the
    time of day, scores their fraction. ``dates`` as for observations.
    """
    documents = _documents(spark, path, TIMELINE_SCHEMA, multi_line, dates)
    # explode() of a null array gives no rows, which is what an absent path means.
    points = documents.select(F.explode("interest_over_time.timeline_data").alias("point"))
    rows = points.select(
        S.epoch_timestamp(F.col("point.timestamp")).alias("date"),
        *[F.get("point.values", F.lit(i))["extracted_value"].alias(n) for i, n in enumerate(names)],
    )
    return in_range(rows, dates)
