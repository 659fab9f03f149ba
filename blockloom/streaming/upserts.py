"""Structured Streaming: tables that grow by micro-batches, each written exactly once under its batch number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch replaces its own partition batch=<n>: a batch that is run again after a failure leaves no
    duplicates. Readers take the newest row per key with newest()."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if transform is None else transform(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, keys: list[str], sequence: str, value: str = "text") -> DataFrame:
    """The value with the greatest sequence number per key, whatever order the rows arrived in."""
    return rows.groupBy(*keys).agg(F.max_by(value, sequence).alias(value))


def op_budget(events: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Batch form: every event with its number per key and whether it is still within the budget."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("step", n).withColumn("allowed", F.col("step") <= most)


def op_budget_stream(events: DataFrame, key: str, most: int) -> DataFrame:
    """Streaming form: running count per key over all batches; (key, steps, allowed) after each batch."""

    def count(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in frames:
            seen += len(pdf)
        state.update((seen,))
        yield pd.DataFrame({key: [name[0]], "steps": [seen], "allowed": [seen <= most]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, steps long, allowed boolean", "steps long", "update", GroupStateTimeout.NoTimeout)


def cancel_group(spark, tag: str) -> None:
    """Stops the jobs that were started under spark.addTag(tag)."""
    spark.interruptTag(tag)
