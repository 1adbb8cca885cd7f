"""Running a stream over what is available now, and reading its result."""

from __future__ import annotations

import threading
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from utterlab.session import shared_folder


def read_stream(
    spark: SparkSession, folder: str, name: str, batch_files: int = 1000
) -> DataFrame:
    """One table of ``folder``, a file or a folder of files, as a file stream; a backlog comes
    in batches of ``batch_files`` files."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", batch_files)
    if any(file.endswith(f"/{name}.parquet") for file in table.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _append(stream: DataFrame, place: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{place}/data")
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _appended(stream: DataFrame, place: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/data")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode result through the exactly-once file sink."""
    place = _place(stream.sparkSession, name)
    _append(stream, place)
    return _appended(stream, place)


def run_with_state(stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Append-mode result, and the state (key, value) that its first stateful operator still
    holds when the input is used up, read from the checkpoint."""
    spark = stream.sparkSession
    place = _place(spark, name)
    _append(stream, place)
    return _appended(stream, place), spark.read.format("statestore").load(f"{place}/state")


def run_updates(stream: DataFrame, name: str) -> DataFrame:
    """Update-mode result: every change, with the number of its batch.

    A batch overwrites its own folder, so a retried batch is not written twice.
    """
    place = _place(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/data/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{place}/data")


def route(stream: DataFrame, good: Column, good_path: str, bad_path: str, state: str) -> StreamingQuery:
    """Rows to one of two folders by a condition, one scan of the batch each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.where(good).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        kept.where(~good).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        kept.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


class LateRows(StreamingQueryListener):
    """Rows that stateful operators dropped behind the watermark, summed over the batches of
    every query of the session, by the id of its run."""

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.dropped[str(progress.runId)] += sum(
            op.numRowsDroppedByWatermark for op in progress.stateOperators
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def of(self, query: StreamingQuery, patience: float = 60.0) -> int:
        """The count of a query that has ended, once its last event was heard."""
        if not self._ended[str(query.runId)].wait(patience):
            raise TimeoutError("no end of the query was reported")
        return self.dropped[str(query.runId)]


def run_arrivals(
    stream: DataFrame, name: str, arrivals: Iterable[Callable[[], None]]
) -> tuple[DataFrame, list[int]]:
    """Append-mode result of a stream that is stopped and resumed: before each run one of
    ``arrivals`` puts new files where the stream reads. Also the rows that came too late, per run.
    """
    spark = stream.sparkSession
    place, listener, late = _place(spark, name), LateRows(), []
    spark.streams.addListener(listener)
    try:
        for arrive in arrivals:
            arrive()
            query = _append(stream, place)
            late.append(listener.of(query))
    finally:
        spark.streams.removeListener(listener)
    return _appended(stream, place), late
