"""Line deduplication by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host when the share of the host's pages that hold it exceeds a ratio. Pages
are counted once for each distinct line, so counting is a plain aggregate with partial sums; of a host's
lines at most (mean lines a page) / ratio can exceed the ratio, so its list of lines to drop is short.
Pages meet that list by host and part: a host with a large share of all pages has as many parts as its
pages need, so it is no hot key at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages of one part of a host, and the share of all pages (1 in so many) above which a host has parts:
#: at most so many hosts are broadcast.
PART_PAGES, LARGE_HOSTS = 500, 1 << 16
#: Tags that begin or end a line of a page.
BLOCK_TAGS = (
    r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|footer|header|section|title|table|tr|td|script|style"
    r"|head|body|html)(?:\s[^>]*)?/?>"
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute address; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def page_lines(html: Column) -> Column:
    """Lines of a page: stretches between block tags and line breaks, trimmed, without empty ones."""
    lines = F.split(F.regexp_replace(html, BLOCK_TAGS, "\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """``host`` and ``drops`` (digests of its lines to drop) from rows ``host``, ``lines``."""
    rows = pages.filter(F.col("host").isNotNull())
    held = rows.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = held.groupBy("host", F.md5(F.col("line").cast("binary")).alias("digest")).agg(F.count("*").alias("n"))
    # No line of fewer pages than this can exceed the ratio of a host that is looked at.
    counts = counts.filter(F.col("n") > ratio * min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    frequent = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_set("digest").alias("drops"))


def large_hosts(rows: DataFrame) -> DataFrame:
    """``host`` and ``parts`` of hosts with more than 1 in ``LARGE_HOSTS`` of all pages: fewer than that many."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    counts = rows.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("pages"))
    parts = F.ceil(F.col("pages") / PART_PAGES).cast("int")
    return counts.filter((F.col("pages") * LARGE_HOSTS > total) & (parts > 1)).select("host", parts.alias("parts"))


def drop_boilerplate(
    pages: DataFrame,
    id_column: str,
    host: Column,
    lines: Column,
    ratio: float = 0.3,
    min_pages: int = 10,
) -> DataFrame:
    """One row a page: id, ``host``, ``n_lines``, ``n_dropped`` and ``text``, the other lines joined.

    Lines held by more than ``ratio`` of the pages of a host go, wherever they occur on a page. Hosts
    with fewer than ``min_pages`` pages, and pages without a host, keep all lines. Null lines stay
    null, with counts of 0. Repeated rows count as pages of their own.
    """
    rows = pages.select(F.col(id_column), host.alias("host"), lines.alias("lines"))
    drops = boilerplate(rows, ratio, min_pages)
    large = large_hosts(rows)
    parts = F.coalesce("parts", F.lit(1))
    # Both joins with the large hosts are broadcasts of a bounded table.
    spread = drops.join(F.broadcast(large), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.join(F.broadcast(large), "host", "left").withColumn(
        "part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")
    )
    joined = rows.drop("parts").join(spread.drop("parts"), ["host", "part"], "left")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("drops", F.md5(x.cast("binary"))))
    )
    return joined.withColumn("kept", kept).select(
        id_column,
        "host",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
