"""Streams over turns: totals per session, kept up to date as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.session import checkpoint_folder


def session_totals(turns: DataFrame) -> DataFrame:
    """Turns and tokens per session, for a stream in update or complete mode or for a batch."""
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )


def stream_session_totals(spark: SparkSession, path: str) -> DataFrame:
    """All files that are there now, streamed once through the stateful aggregate; the final state.

    The state and the result are written to the shared checkpoint folder.
    """
    folder = f"{checkpoint_folder(spark)}/streams/{uuid.uuid4().hex}"
    batch = spark.read.parquet(path)
    source, _, name = path.rstrip("/").rpartition("/")
    # a single file is streamed through its folder, a folder through itself
    reader = spark.readStream.schema(batch.schema)
    single = len(batch.inputFiles()) == 1 and batch.inputFiles()[0].endswith(name)
    stream = reader.option("pathGlobFilter", name).parquet(source) if single else reader.parquet(path)
    totals = session_totals(stream)

    def publish(state: DataFrame, epoch: int) -> None:
        state.write.mode("overwrite").parquet(f"{folder}/out-{epoch}")

    running = (
        totals.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    epochs = [p["batchId"] for p in running.recentProgress if p["numInputRows"] > 0]
    if not epochs:
        return session_totals(batch)
    return spark.read.parquet(f"{folder}/out-{max(epochs)}")
