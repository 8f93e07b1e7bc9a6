"""Structured Streaming ingestion: lines to events, ledger rows and rejects; then derived tables.

Each micro-batch is written under its number, so a batch that is replayed after
a failure overwrites itself: exactly once, without locks. The checkpoint is the
cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events as ev
from ..operators import graph
from ..sources.hooks import decode_lines


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines of the files that arrive in a folder; so many files a batch hold back the rest."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)


def _put(df: DataFrame, base: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")


def write_batch(lines: DataFrame, batch: int, base: str) -> None:
    """One batch: events with ids of their own range, ledger rows, rejects, and the graph's mentions.

    Ids are dense within a batch and grow with it: the high-water mark is read from
    the batches before, not from what this one may have written already.
    """
    spark = lines.sparkSession
    decoded = decode_lines(lines).withColumn("_n", F.monotonically_increasing_id()).persist()
    try:
        incoming = ev.prepare(decoded.filter("event IS NOT NULL").select("event.*", "_n"))
        old = _existing(spark, f"{base}/events")
        mark = 0 if old is None else old.filter(F.col("batch") < batch).agg(ev.corpus_size(old)).first()[0]
        numbered = ev.dense_ids(incoming, ["_n"], F.shiftright("_n", 33), mark).drop("_n")
        _put(numbered, base, "events", batch)
        _put(decoded.filter("gain IS NOT NULL").select("gain.*"), base, "ledger", batch)
        _put(decoded.filter("rejected").select("value"), base, "dead_letter", batch)
        _put(graph.extract_entities(spark.read.parquet(f"{base}/events/batch={batch}")), base, "mentions", batch)
    finally:
        decoded.unpersist()


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def start(lines: DataFrame, base: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = lines.writeStream.foreachBatch(lambda df, n: write_batch(df, n, base)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()


def current_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of all batches: weights follow from counts, so no order matters."""
    mentions = spark.read.parquet(f"{base}/mentions").drop("batch")
    return graph.build_entities(mentions), graph.build_edges(mentions)


def rebuild_graph(spark: SparkSession, events: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the graph anew under the version of its rules and returns it; readers of the old version keep their files."""
    out = f"{path}/rules={graph.RULES_VERSION}"
    mentions = graph.extract_entities(events)
    graph.build_entities(mentions).write.mode("overwrite").parquet(f"{out}/entities")
    graph.build_edges(mentions).write.mode("overwrite").parquet(f"{out}/edges")
    return spark.read.parquet(f"{out}/entities"), spark.read.parquet(f"{out}/edges")

