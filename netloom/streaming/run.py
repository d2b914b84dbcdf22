"""Drive a streaming query over files already present, and read what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from netloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEPT_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


@dataclass(frozen=True)
class StreamRun:
    """Everything written so far, and what this run's micro-batches reported."""
    rows: DataFrame
    batches: list

    @property
    def late_rows(self) -> int:
        """Rows that came behind the watermark and were dropped."""
        return sum(op.numRowsDroppedByWatermark for b in self.batches for op in b.stateOperators)

    @property
    def state_rows(self) -> list[int]:
        """Rows of state after each micro-batch."""
        return [sum(op.numRowsTotal for op in b.stateOperators) for b in self.batches]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the start of one query (which takes a copy); the caller's own ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drive(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], place: str | None = None,
          stateful: bool = False, files_per_batch: int = 2) -> StreamRun:
    """Stream the parquet files under ``path`` (a few per micro-batch, oldest first) through ``transform``.

    ``place`` is a folder that every executor reaches, for output and checkpoint: another call with the same one goes on
    where the last call ended, with the files that came since. Without it a new folder is taken and the run starts anew.
    """
    place = place or scratch_path(spark, "stream")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    result = transform(source)
    with _settings(spark, {KEPT_PROGRESS: "10000"} | ({PROVIDER: ROCKSDB} if stateful else {})):
        query = (result.writeStream.format("parquet").option("path", f"{place}/out")
                 .option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return StreamRun(spark.read.schema(result.schema).parquet(f"{place}/out"), list(query.recentProgress))


def run_available(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame],
                  stateful: bool = False, files_per_batch: int = 2) -> DataFrame:
    """Rows of one run from the start."""
    return drive(spark, path, schema, transform, None, stateful, files_per_batch).rows
