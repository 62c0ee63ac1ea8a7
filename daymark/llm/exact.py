"""Exact deduplication as a Grace hash join of the collection with itself.

1. Each input task collapses its own rows in an open-addressing table that compares complete
   contents, so that a text with very many copies leaves one entry a task.
2. Entries are dealt to buckets by a hash of their content. A bucket above ``bucket_bytes`` that
   holds more than one hash is spilled to the shared folder and dealt again by another hash, each
   into buckets of its own, level after level; every bucket that fits is resolved by one table of complete contents.
3. Every row gets its entry's result. A row is joined by the number of its entry, which stands for
   rows of one task only, so copies do not meet in one partition.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_rows
from daymark.llm.sift import Sift, fresh
from daymark.session import materialise

#: Bytes of content that one bucket, or one task's first table, holds at most; bytes of one batch.
BUCKET_BYTES, BATCH_BYTES = 16 << 20, 2 << 20
#: Buckets of one level at most; with more content than they hold the next level takes over.
FAN_OUT = 2_000


class ContentTable:
    """Open addressing with linear probing; equal means equal in complete content."""

    def __init__(self, slots: int = 1 << 12):
        self.slots = array("q", [-1]) * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """Index of the content's entry, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.hashes)
        self.slots[at] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = array("q", [-1]) * (mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def normal(text: Column) -> Column:
    """The compared content: each stretch of blanks is one space, null is empty."""
    # A lone space stays as it is, which spares most of the work.
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def smaller(a, b):
    """The smaller id; a missing one counts as larger than any."""
    return b if a is None else (a if b is None else min(a, b))


def collapse(limit: int):
    """Rows of one task to members (one a row) and entries (one a distinct content)."""

    def run(batches):
        task, serial = TaskContext.get().partitionId() << 40, 0
        table, entries = ContentTable(), []

        def flush():
            start, size = 0, 0
            for end, content in enumerate(table.contents, 1):
                size += len(content)
                if size >= BATCH_BYTES or end == len(entries):
                    part, contents = entries[start:end], table.contents[start:end]
                    nothing = pa.nulls(len(part))
                    yield [
                        [e[0] for e in part],
                        nothing.cast(pa.int64()),
                        nothing.cast(pa.int64()),
                        nothing.cast(pa.binary()),
                        table.hashes[start:end],
                        contents,
                        [e[1] for e in part],
                        [e[2] for e in part],
                        [e[3] for e in part],
                        [len(c) for c in contents],
                    ]
                    start, size = end, 0

        for batch in batches:
            reps, order = [], []
            for row, (doc, content, h) in enumerate(
                zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)))
            ):
                at, new = table.place(h, content)
                if new:
                    entries.append([task | serial, doc, serial, 0])
                entry = entries[at]
                if smaller(entry[1], doc) != entry[1]:
                    entry[1], entry[2] = doc, serial
                entry[3] += 1
                reps.append(entry[0])
                order.append(serial)
                serial += 1
            nothing = pa.nulls(batch.num_rows)
            yield [
                pa.array(reps, pa.int64()), batch.column(0), pa.array(order, pa.int64()), batch.column(2),
                nothing.cast(pa.int64()), nothing.cast(pa.binary()), *[nothing.cast(pa.int64())] * 4,
            ]
            if table.bytes > limit:
                yield from flush()
                table, entries = ContentTable(), []
        if entries:
            yield from flush()

    return run


MEMBERS = (
    "rep long, id long, serial long, sha binary, "
    "hash long, content binary, keep long, keep_serial long, size long, bytes long"
)


def resolve(batches):
    """Entries of one bucket after another to (entry, id that stays, its serial if it is here, group size)."""
    bucket, table, groups, entries = None, ContentTable(), [], []

    def settled():
        for start in range(0, len(entries), 10_000):
            part = entries[start : start + 10_000]
            yield [
                [e[0] for e in part],
                [groups[e[1]][0] for e in part],
                [e[2] if groups[e[1]][1] == e[0] else -1 for e in part],
                [groups[e[1]][2] for e in part],
            ]

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for path, rep, h, content, keep, serial, size in zip(*columns):
            if path != bucket:
                yield from settled()
                bucket, table, groups, entries = path, ContentTable(), [], []
            at, new = table.place(h, content)
            if new:
                groups.append([keep, rep, 0])
            group = groups[at]
            first = smaller(group[0], keep)
            # Of several rows with the smallest id, the one of the smallest entry stays.
            if first != group[0] or (keep == first and rep < group[1]):
                group[0], group[1] = first, rep
            group[2] += size
            entries.append((rep, at, serial))
    yield from settled()


RESOLVED = "rep long, keep_id long, keep_serial long, group_size long"


def find_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row a document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their normalised contents are; null is the empty text. The row of smallest
    id stays (a null id counts as largest); of several rows with that id, one. Other columns are
    not looked at.
    """
    body = normal(F.col(text))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), body.alias("body")).select(
        "id",
        F.col("body").cast("binary").alias("content"),
        F.unhex(F.sha2("body", 256)).alias("sha"),
        F.xxhash64("body").alias("hash"),
    )
    table = materialise(map_rows(rows, collapse(bucket_bytes), MEMBERS), "collapsed")
    members = table.filter(F.col("id").isNotNull() | F.col("sha").isNotNull()).select("rep", "id", "serial", "sha")
    # The path tells the bucket an entry was spilled from; a bucket is dealt again by itself.
    pending = table.filter(F.col("hash").isNotNull()).select(
        F.lit(0).cast("long").alias("path"), "rep", "hash", "content", "keep", "keep_serial", "size", "bytes"
    )
    resolved, level = None, 0
    while True:
        total = pending.agg(F.sum("bytes")).first()[0] or 0
        # Buckets of half the limit on average, so that few come out above it.
        count = min(FAN_OUT, 1 + int(2 * total // bucket_bytes))
        dealt = pending.withColumn("bucket", F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(count)).cast("int"))
        large = (
            dealt.groupBy("path", "bucket")
            .agg(F.sum("bytes").alias("b"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
            .filter((F.col("b") > bucket_bytes) & (F.col("lo") < F.col("hi")))
            .select("path", "bucket")
        )
        more = not large.isEmpty()
        fits = dealt.join(large, ["path", "bucket"], "left_anti") if more else dealt
        placed = fits.repartitionById(count, F.col("bucket"))
        # After a spill a task has one bucket of each path, one after another.
        placed = placed.sortWithinPartitions("path") if level else placed
        part = map_rows(
            placed.select("path", "rep", "hash", "content", "keep", "keep_serial", "size"), resolve, RESOLVED
        )
        resolved = part if resolved is None else resolved.unionByName(part)
        if not more:
            break
        spilled = dealt.join(large, ["path", "bucket"], "left_semi")
        pending = materialise(spilled.withColumn("path", F.xxhash64("path", "bucket")).drop("bucket"), "spilled")
        level += 1
    joined = members.join(resolved, "rep")
    return joined.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("serial") == F.col("keep_serial")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; repeated rows stay once.

    Of several rows with the smallest id of a text, the one whose columns have the smallest hash stays.
    Only rows that may have been dropped are joined with the result.
    """
    found = materialise(find_copies(docs, id_column, text), "copies")
    digest, stays, of = (fresh(docs, c) for c in ("sha256", "stays", "of"))
    kept = found.filter("kept").select(F.col(id_column).alias(stays), F.col("text_sha256").alias(of))
    hashed = docs.withColumn(digest, F.sha2(normal(F.col(text)), 256))
    identity = F.col(id_column).cast("long")
    sift = Sift(found.filter("not kept"), F.col(id_column), F.col("text_sha256"))
    clear, unsure = sift.split(hashed, identity, F.col(digest))
    same = identity.eqNullSafe(F.col(stays)) & (F.col(digest) == F.col(of))
    staying = unsure.join(kept, same, "left_semi")
    whole = F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
    one = staying.groupBy(identity.alias(stays), digest).agg(F.min_by(whole, F.xxhash64(whole)).alias(of))
    return clear.drop(digest).unionByName(one.select(f"{of}.*"))
