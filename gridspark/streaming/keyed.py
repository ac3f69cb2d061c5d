"""The newest records of every key, held in the state store and read from there."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from datetime import timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """A list of the newest ``n`` rows per key, cleared by a timer once the watermark is ``keep`` past the newest."""

    def __init__(self, schema: T.StructType, n: int, ts: str, tie: str, keep: timedelta | None):
        self.schema, self.n, self.ts, self.tie, self.keep = schema, n, ts, tie, keep
        self.zoned = isinstance(schema[ts].dataType, T.TimestampType)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("newest", self.schema)

    def _time(self, row: Row):
        """Rows arrive with a zone and come back from the state in local time without one."""
        ts = row[self.ts]
        return ts.astimezone(timezone.utc) if ts is not None and self.zoned else ts

    def _rank(self, row: Row) -> tuple:
        """Missing times and ties come last."""
        ts, tie = self._time(row), row[self.tie]
        return (ts is not None, ts if ts is not None else 0, tie is not None, tie if tie is not None else 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.fieldNames()
        held = [Row(*names)(*r) for r in self.rows.get()] if self.rows.exists() else []

        def both() -> Iterator[Row]:
            yield from held
            for r in rows:
                yield Row(*names)(*[r[c] for c in names])

        newest = heapq.nlargest(self.n, both(), key=self._rank)  # holds n rows, however many arrive
        self.rows.put([tuple(r) for r in newest])
        top = self._time(newest[0])
        if self.keep is not None and top is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((top + self.keep).timestamp() * 1000))
        yield Row(kept=len(newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rows.clear()
        yield Row(kept=0)

    def close(self) -> None:
        pass


def keep_newest(stream: DataFrame, folder: str, keys: Sequence[str], n: int = 100, ts: str = "ts", tie: str = "id",
                keep: timedelta | None = None, lateness: str = "0 seconds", parts: int = 16, available_now: bool = True):
    """Keep the newest ``n`` records of every key in the state store; nothing but the checkpoint is written.

    A key's records are dealt to ``parts`` lists by a hash of ``tie``, so a key with a third of all rows has no task of
    its own; a list holds at most ``n`` rows.  With ``keep`` a timer clears a list when the watermark, which follows the newest
    TIMESTAMP ``ts`` by ``lateness``, has passed its newest record by that much, and records behind the watermark are not taken.
    """
    spark = stream.sparkSession
    taken = stream.withWatermark(ts, lateness) if keep is not None else stream
    dealt = taken.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(parts)).cast("int"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema.fields])
    kept = dealt.groupBy(*keys, "_part").transformWithState(
        _Newest(schema, n, ts, tie, keep), "kept long", "update", "eventTime" if keep is not None else "none")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # a query keeps the setting it was started with
    try:
        writer = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(STORE, before)


def read_newest(spark: SparkSession, folder: str, keys: Sequence[str], n: int = 100, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``n`` records of every key as of the last batch."""
    lists = (spark.read.format("statestore").option("stateVarName", "newest").load(folder).select("list_element.*"))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), F.desc_nulls_last(tie))
    return lists.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_at")
