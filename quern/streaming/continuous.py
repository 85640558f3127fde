"""Continuous datasets: a stream of events rolled into files by day, and windows over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.table import TS, Table


class Continuous:
    """Events in files by day.  ``record`` appends a stream, exactly once by its checkpoint; a window
    reads only the days it touches."""

    def __init__(self, engine, path: str, time: str = "ts"):
        self.engine, self.path, self.time = engine, path.rstrip("/"), time

    def record(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Starts to append; with ``every`` a batch each interval, else all there is now and then ends."""
        days = stream.withColumn("day", F.to_date(self.time))
        write = days.writeStream.format("parquet").partitionBy("day").option("path", f"{self.path}/data").option("checkpointLocation", f"{self.path}/state").outputMode("append")
        return (write.trigger(processingTime=every) if every else write.trigger(availableNow=True)).start()

    def manifest(self) -> DataFrame:
        """Earliest and latest time by day."""
        return self._read().groupBy("day").agg(F.min(self.time).alias("earliest"), F.max(self.time).alias("latest"), F.count("*").alias("rows"))

    def _read(self) -> DataFrame:
        return self.engine.spark.read.parquet(f"{self.path}/data")

    def window(self, from_: str, to: str, dataset: str | None = None) -> DataFrame:
        """Events from one time to another, both included."""
        a, b = F.lit(from_).cast("timestamp"), F.lit(to).cast("timestamp")
        df = self._read().where(F.col("day").between(F.to_date(a), F.to_date(b)) & F.col(self.time).between(a, b)).drop("day")
        if dataset:
            self.engine.register(dataset, Table(df.withColumn(TS, F.col(self.time))))
        return df


class Sensor:
    """The latest value of a stream, for read_sensor(name)."""

    def __init__(self, engine, name: str, stream: DataFrame, time: str = "ts"):
        self.value: dict | None = None
        self.time = time
        engine.sensors[name] = lambda: self.value
        self.query = stream.writeStream.foreachBatch(self._take).trigger(availableNow=True).start()

    def _take(self, batch: DataFrame, _: int) -> None:
        rows = batch.orderBy(F.desc(self.time)).limit(1).collect()
        if rows and (self.value is None or rows[0][self.time] >= self.value[self.time]):
            self.value = rows[0].asDict()


def latest_by_key(events: DataFrame, key: str, time: str, until: str) -> DataFrame:
    """The last event of each key up to a time."""
    return events.where(F.col(time) <= F.lit(until).cast("timestamp")).groupBy(key).agg(F.max_by(F.struct("*"), time).alias("e")).select("e.*")


def on_batch(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls fn with each batch, once more for one whose task was lost."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fn).trigger(availableNow=True).start()
