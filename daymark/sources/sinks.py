"""Table outputs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

# Output table names.
COMBINED = "01_combined_daily"
WITH_TARGET = "02_combined_with_target"
ENGINEERED = "03_engineered_features"
HISTORY = "04_historical_predictions"
FORECAST = "05_next_7days_predictions"
SUMMARY = "06_model_summary"


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    """Overwrite ``folder/name`` with headed CSV parts, as many as the plan has partitions."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, folder: str, name: str, by_year: bool = True) -> str:
    """Overwrite ``folder/name`` with Parquet, one directory per year so date filters prune."""
    path = f"{folder}/{name}"
    if by_year:
        df = df if "year" in df.columns else df.withColumn("year", F.year("date"))
        # Rows of a year meet before the write, and a year too large for one task is split.
        df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def read_csv_table(spark: SparkSession, folder: str, name: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}")


def first_record(spark: SparkSession, folder: str, name: str, schema: StructType | str) -> dict:
    """First record of a saved table as a dict, or a message when the table is not there."""
    try:
        row = read_csv_table(spark, folder, name, schema).limit(1).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        row = None
    return row.asDict() if row else {"message": f"table {name} has not been written yet"}


# ---------------------------------------------------------------- runs and their manifests

MANIFEST_SCHEMA = "run string, published timestamp, tables array<string>"


def new_run() -> str:
    """Name of a run folder; names sort by time."""
    return f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def run_folder(out: str, run: str) -> str:
    return f"{out}/runs/{run}"


def publish(spark: SparkSession, out: str, run: str, tables: list[str]) -> None:
    """Make a finished run the one that readers see.

    A run's tables lie in a folder of their own, and its manifest is written last. Spark shows the file
    of a manifest only when its job is committed, so a run that stops anywhere before leaves the
    earlier result as it was.
    """
    now = dt.datetime.now(dt.timezone.utc)
    row = spark.createDataFrame([(run, now, tables)], MANIFEST_SCHEMA)
    row.coalesce(1).write.json(f"{out}/manifests/{run}")


def published_run(spark: SparkSession, out: str) -> str | None:
    """The run published last, or None."""
    try:
        manifests = spark.read.schema(MANIFEST_SCHEMA).json(f"{out}/manifests/*")
        row = manifests.agg(F.max(F.struct("published", "run")).alias("last")).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return row["last"]["run"] if row["last"] else None


def published(spark: SparkSession, out: str) -> str:
    """Folder of the tables that readers should see."""
    run = published_run(spark, out)
    if run is None:
        raise FileNotFoundError(f"no finished run at {out}")
    return run_folder(out, run)
