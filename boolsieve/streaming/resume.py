"""Work lists that are finished bit by bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, done: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Runs ``work`` on the JSON lines that appeared in a folder since the last call and appends its rows to ``done``.

    The stream's checkpoint knows what was read, so a run that broke off goes on where it was.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{done}/batch={epoch}")

    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
