"""Responses that arrive as files: parsed and appended one by one, or put together per example.

``ingest_responses_stream`` is stateless and appends every response of every file exactly once, so
a crash loses at most the batch in flight. ``ingest_results_stream`` keeps state per example and gives
an example's responses when the last of its stages has come, once, also if files are sent again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cotflow import schemas
from cotflow.functions.tags import extract_cot, extract_edges, extract_nodes, extract_segments


def parse_stages(responses: DataFrame) -> DataFrame:
    text = F.col("response")
    return responses.select(
        "example_id",
        "stage",
        F.when(F.col("stage") == "cot", extract_cot(text)).alias("cot"),
        F.when(F.col("stage") == "segments", extract_segments(text)).alias("segments"),
        F.when(F.col("stage") == "graph", extract_nodes(text)).alias("nodes"),
        F.when(F.col("stage") == "graph", extract_edges(text)).alias("edges"),
    )


def ingest_responses_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Parse all response files present in ``source`` into the parquet table ``target``."""
    arriving = (
        spark.readStream.schema(schemas.RESPONSE)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    return (
        parse_stages(arriving)
        .writeStream.format("parquet")
        .option("compression", "zstd")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


STAGES = ("cot", "segments", "graph")
GATHERED = "example_id string, cot_response string, segments_response string, graph_response string"
# State lies on the executors' disks within bounded memory, and only its changes are checkpointed. An
# example's texts are in the state and again in the changes of every batch that brings one, so all are
# compressed well, and what only older batches need goes as soon as no restart can ask for it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def _completed(rows: DataFrame) -> DataFrame:
    """The examples of ``rows`` (example_id, stage, response, needed) whose last stage comes in this batch.

    Besides the largest text the state has the first and the last batch of each stage, told apart by the
    batches' timestamps, which a repeated batch keeps. An example was complete before if every stage it
    waits for has come in another batch than this one.
    """
    now, needed = F.current_timestamp(), F.col("needed")
    unknown = needed.isNull() | (F.size(F.array_except(needed, F.array(*[F.lit(s) for s in STAGES]))) > 0)
    checked = F.when(unknown, F.raise_error(F.lit("an example waits for an unknown stage")).cast("array<string>")).otherwise(needed)
    usable = F.col("stage").isin(*STAGES) & F.col("response").isNotNull()
    rows = rows.select("example_id", "stage", "response", checked.alias("needed"), now.alias("came")).where(usable)
    columns = [F.max("needed").alias("needed")]
    for s in STAGES:
        of_stage = F.col("stage") == s
        came = F.when(of_stage, F.col("came"))
        # Of several texts the largest counts, as where all responses are at hand.
        columns += [F.max(F.when(of_stage, F.col("response"))).alias(f"{s}_response"), F.min(came).alias(f"{s}_first"), F.max(came).alias(f"{s}_last")]
    held = rows.groupBy("example_id").agg(*columns)
    complete, before = F.size("needed") > 0, F.lit(True)
    for s in STAGES:
        free = ~F.array_contains("needed", s)
        complete = complete & (free | F.col(f"{s}_response").isNotNull())
        before = before & (free | (F.col(f"{s}_first") != now) | (F.col(f"{s}_last") != now))
    return held.where(complete & ~before).select("example_id", *[f"{s}_response" for s in STAGES])


def ingest_results_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, needed: DataFrame, files_per_batch: int = 1000
) -> StreamingQuery:
    """Put the responses of each example together as their files arrive in ``source``.

    ``needed`` has one row per example: example_id and the array of stages it waits for. An example
    is written when its last stage has come; responses of it that come later, and examples that
    ``needed`` does not have, change nothing; an example keeps what it waits for between runs. Every batch is written to a folder of its own number,
    which a repeated batch replaces, so results are neither lost nor doubled by a restart; batches
    without results leave none. ``read_results_stream`` reads them all.
    """
    arriving = (
        spark.readStream.schema(schemas.RESPONSE)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    known = needed.select("example_id", F.col("needed").cast("array<string>").alias("needed"))
    gathered = _completed(arriving.join(known, "example_id"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")
        # The shuffled texts of earlier batches stay on disk until the driver has collected its garbage,
        # and a batch makes too little of it for that.
        spark.sparkContext._jvm.System.gc()

    writer = (
        gathered.writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    own = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        # A query keeps the settings it starts with.
        return writer.start()
    finally:
        for name, value in own.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_results_stream(spark: SparkSession, target: str) -> DataFrame:
    """The responses put together so far, as rows (example_id, stage, response)."""
    rows = spark.read.schema(f"{GATHERED}, batch long").parquet(target)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_response").alias("response")) for s in STAGES])
    return rows.select("example_id", F.inline(stages)).where(F.col("response").isNotNull())
