"""Feature tables kept up to date from a stream of landed rows.

Every micro-batch is an update of a :class:`daymark.operators.incremental.FeatureStore`: its rows are
appended, or replace those with the same place in their series, and only the buckets they reach are
computed again. Rows may come in any order and as late as they like, as the store and not a watermark
decides what they change; state is the store's reduced pieces, not a growing buffer. A micro-batch that
is delivered twice replaces its rows by themselves, so the table is the same as after one delivery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from daymark.operators import align
from daymark.operators.incremental import FeatureStore


def keep_features(
    stream: DataFrame,
    store: FeatureStore,
    checkpoint: str,
    newest: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Start taking ``stream`` into ``store``; offsets are kept below ``checkpoint``.

    Without ``every`` (a trigger interval such as ``1 minute``) all rows that are there are taken, and the
    query ends. Several rows of a micro-batch with one place in a series are an error, unless ``newest``
    names a column whose largest value wins; equal rows count once.
    """
    identity = [*store.keys, store.time, *store.ties]

    def take(batch: DataFrame, _: int) -> None:
        if newest is None:
            rows = batch.select(*store.schema.names).distinct()
        else:
            rows = align.latest_load(batch, newest, identity)
        store.update(rows)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
