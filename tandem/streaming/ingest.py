"""Incremental ingest: new image rows arrive in micro-batches and are merged and scored against the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.mutations import upsert
from tandem.plans.blocked import best_pairs
from tandem.sources.scan import BucketTable


def merge_batch(batch: DataFrame, table_path: str, key: str = "id", order: str = "indexedat") -> None:
    """Upserts one micro-batch into the ``BucketTable`` at ``table_path``; of rows of one key the latest by ``order``
    wins.  Only the buckets the batch touches are read and rewritten.  Running a batch again changes nothing, so a
    batch repeated after a failure is harmless."""
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in batch.columns)), F.struct(F.col(order).isNotNull(), F.col(order))).alias("r")).select("r.*")
    merged = lambda old, new: new if old is None else upsert(old, new, [key]).select(*batch.columns)
    BucketTable(batch.sparkSession, table_path, key).merge(newest, merged)


def stream_upserts(spark: SparkSession, source: str, schema: str, table_path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, files_per_batch: int = 10) -> StreamingQuery:
    """Reads a folder of parquet files as they arrive and merges them; ``after`` gets every batch once it is merged."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def each(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch, table_path)
        if after:
            after(batch, epoch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cross_score(batch: DataFrame, existing: DataFrame, k: int = 50) -> DataFrame:
    """Best pairs between a batch of vectors and the vectors that were there (id, scope, vec), as after a new folder."""
    fresh = batch.select("id", F.lit("all").alias("scope"), "vec", F.lit(True).alias("isnew"))
    old = existing.join(batch.select("id"), "id", "left_anti").select("id", F.lit("all").alias("scope"), "vec", F.lit(False).alias("isnew"))
    return best_pairs(fresh.unionByName(old), k, only_new=True)
