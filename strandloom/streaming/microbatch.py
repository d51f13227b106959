"""Running a transform over files as they arrive, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, source: str = "parquet", files_per_batch: int = 100) -> StreamingQuery:
    """Applies ``transform`` to each batch of new files in ``folder`` and adds the result to ``out``.

    The batch's number is part of its output folder, which is written anew if the batch runs again,
    so a lost driver or executor leaves neither gaps nor repeats. Ends when no new files are there.
    """

    def save(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(source).load(folder)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
