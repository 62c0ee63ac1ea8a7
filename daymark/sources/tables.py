"""Daily series derived from the order, line item, customer and event tables.

Money has exactly two decimals, so sums run over whole cents: exact, independent of the order
of addition, and far cheaper than wide decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the day from which the derived exchange-rate series is published.
FX_FIRST_DAY = "1995-06-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def total(column: str) -> Column:
    return F.sum(cents(column)) / F.lit(100.0)


def market_price(spark: SparkSession, folder: str) -> DataFrame:
    """One price series for the whole market: order value per day."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(total("o_totalprice").alias("price"), F.count("*").alias("n_orders"))
    )


def segment_price(spark: SparkSession, folder: str) -> DataFrame:
    """One price series per market segment.

    Orders are summed per customer and day before they meet the customer table, so a customer
    with a huge share of the orders enters the join as at most one row per day.
    """
    per_customer = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.sum(cents("o_totalprice")).alias("cents"), F.count("*").alias("n"))
    )
    segments = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    return (
        per_customer.join(segments, per_customer.o_custkey == segments.c_custkey)
        .groupBy("series_id", "date")
        .agg((F.sum("cents") / F.lit(100.0)).alias("price"), F.sum("n").alias("n_orders"))
    )


def ship_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Line items summed per ship day: what the rate, exchange-rate and trend series start from."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.count("*").alias("n"),
            total("l_discount").alias("discount"),
            total("l_extendedprice").alias("revenue"),
            F.sum("l_quantity").alias("quantity"),
        )
    )


def ship_rates(daily: DataFrame) -> DataFrame:
    """Daily rate (null at weekends) and exchange rate (null before its first day)."""
    published = F.col("date") >= F.lit(FX_FIRST_DAY).cast("date")
    return daily.select(
        "date",
        F.when(F.weekday("date") < 5, F.col("discount") / F.col("n")).alias("rate"),
        F.when(published, F.col("revenue") / F.col("quantity")).alias("fx"),
    )


def weekly_trend(daily: DataFrame) -> DataFrame:
    """Weekly activity: line items and quantity per week, dated on its Monday."""
    return daily.groupBy(F.date_sub("date", F.weekday("date")).alias("date")).agg(
        F.sum("n").alias("trend_a"), F.sum("quantity").cast("bigint").alias("trend_b")
    )


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scored observations: an urgency label and a score on a 0.001 grid, so with ties."""
    score = F.least(F.floor(F.col("o_totalprice") / 500.0) / F.lit(1000.0), F.lit(1.0))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("actual"),
        (score > 0.5).cast("int").alias("predicted"),
        score.alias("probability_up"),
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events as a few long series, one per event type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("series_id"), "ts", "event_id", F.col("value").alias("price")
    )


def event_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """One series per event-value band, with the purchase value known only at purchases."""
    return table(spark, folder, "events").select(
        F.when(F.col("value") < 10, "low").otherwise("high").alias("series_id"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"),
    )
