"""Ingest of records as they arrive."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftlight.operators.embed import Embedder
from siftlight.sources.store import RETRIES, Properties, Store, difference, fresh_rows, hashed
from siftlight.sources.versions import Conflict


def append_batch(store: Store, records: DataFrame, embedder: Embedder) -> int:
    """Adds the texts of ``records`` that the table lacks; nothing is dropped. A batch that
    is given again adds nothing, so each text gets there once. Other writers may work at the
    same time: what they have published by then is there too."""
    for _ in range(RETRIES):
        with contextlib.suppress(Conflict):
            return _append(store, records, embedder)
    return _append(store, records, embedder)


def _append(store: Store, records: DataFrame, embedder: Embedder) -> int:
    properties, after = Properties(embedder.model_id, embedder.dim), store.versions.last()
    wanted = hashed(records, embedder.model_id)
    if not (store.exists() and store.is_current(properties)):
        if wanted.isEmpty():
            return 0
        store.write(fresh_rows(wanted, embedder), properties, after)
        return store.read().count()
    fresh, _, _ = difference(wanted, store.read().select("chunk_hash"))
    fresh = fresh.persist()
    try:
        added = fresh.count()
        if added:
            store.change(fresh_rows(fresh, embedder), None, after)  # a segment of its own
    finally:
        fresh.unpersist()
    return added


def start(records: DataFrame, store: Store, embedder: Embedder, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``append_batch`` on a stream of (text[, source])."""
    writer = records.writeStream.foreachBatch(lambda batch, _: append_batch(store, batch, embedder) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
