"""Incremental ingest as a stream of landed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx

#: What a change says of a chunk: it is new or has another text, or it is no longer there.
CHANGED, GONE = "changed", "gone"
_CHANGES = "doc_id string, chunk_index int, text string, change string, version long"
_STATE = "version long, tie string, digests array<string>"


def ingest(spark: SparkSession, landing: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None], delay: str = "1 hour") -> StreamingQuery:
    """Hands each batch of new (doc_id, text) versions to ``write``; a version seen within ``delay`` is dropped."""
    rows = spark.readStream.schema(schema).parquet(landing)
    keyed = rows.withColumn("text_hash", F.sha1(F.coalesce("text", F.lit("")).cast("binary"))).withWatermark("landed_at", delay)
    fresh = keyed.dropDuplicatesWithinWatermark(["doc_id", "text_hash"])
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The chunks by which the newest version of one document differs from the last one that was told."""
    newest = None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if newest is None or (row.version, row.tie) > newest[:2]:
                newest = (row.version, row.tie, [c["text"] for c in row.chunks], [c["digest"] for c in row.chunks])
    before = state.getOption
    if newest is None or (before is not None and (newest[0], newest[1]) <= (before[0], before[1])):
        return
    version, tie, texts, digests = newest
    old = list(before[2]) if before is not None else []
    rows = [(key[0], i, t, CHANGED, version) for i, (t, d) in enumerate(zip(texts, digests, strict=True)) if i >= len(old) or old[i] != d]
    rows += [(key[0], i, None, GONE, version) for i in range(len(digests), len(old))]
    state.update((version, tie, digests))
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "change", "version"])


def chunk_changes(versions: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Changed chunks and tombstones of stale ones, of a stream of versions (doc_id, version, text) of documents.

    The state of a document is its newest version and a digest for each chunk, no
    texts: a version emits chunks of another digest, and tombstones from the
    place on where a shorter text ends. Of versions in one batch the newest
    counts; one that is older than what was told, or the same again, changes
    nothing; of equal version numbers the greater digest of the text wins, in
    whatever order they come. A null or empty text has no chunk. Rows of null
    doc_id or version are left out; other columns aren't read.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    cut = F.transform(tx.windows(text, size, overlap), lambda w: F.struct(w["text"].alias("text"), F.sha1(w["text"].cast("binary")).alias("digest")))
    rows = versions.where("doc_id is not null and version is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("long").alias("version"), F.sha1(text.cast("binary")).alias("tie"), cut.alias("chunks"))
    return rows.groupBy("doc_id").applyInPandasWithState(_changes, _CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def keep_chunks(changes: DataFrame, table, checkpoint: str, as_of: str) -> StreamingQuery:
    """Writes changes to a bucketed table of chunks (chunk_id, doc_id, chunk_index, text): only touched buckets are rewritten.

    A batch that is run again after a loss writes the same rows again, so the table comes out the same.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        named = batch.withColumn("chunk_id", F.format_string("%s_c%03d", "doc_id", "chunk_index"))
        table.upsert(named.where(F.col("change") == CHANGED).select("chunk_id", "doc_id", "chunk_index", "text"), as_of)
        table.delete(named.where(F.col("change") == GONE).select("chunk_id"))
        batch.unpersist()

    return changes.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
