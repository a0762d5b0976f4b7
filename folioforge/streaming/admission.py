"""The admission limiter over a stream of requests, with one key's admitted times as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.operators.admission import LIMIT, SECONDS, Limiter

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """A key's admitted times as a list of at most ``limit`` longs, which go when their span has passed.

    Under event time a timer at the end of the last admitted span clears the key; under
    processing time each entry has a time to live. Either way a key that falls silent
    leaves no state behind.
    """

    def __init__(self, limit: int, seconds: int, live: bool):
        self.limit, self.seconds, self.live = limit, seconds, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long", self.seconds * 1000 + 1 if self.live else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows)).sort_values(["micros", "tie"])
        book = Limiter(self.limit, self.seconds, [t for (t,) in self.times.get()])
        admitted = [book.admit(int(t)) for t in told["micros"]]
        if book.times:
            self.times.put([(t,) for t in book.times])
        else:
            self.times.clear()
        if not self.live:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if book.times:
                self.handle.registerTimer(max(book.times[-1] // 1000 + self.seconds * 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame({"tie": told["tie"], "key": key[0], "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, key: str, time: str, tie: str, limit: int = LIMIT, seconds: int = SECONDS, late: str = "10 minutes", live: bool = False) -> DataFrame:
    """(tie, key, admitted) of each request. Requests of one batch go in order of time.

    Those later than the watermark are dropped, and a key's state goes when the watermark has
    passed its span. ``live`` is for requests that come as they happen: none is dropped, and
    state goes by the clock. The session's state store must be the RocksDB one, and is
    made so. A key's rows of one batch are held together; trigger options bound a batch.
    """
    requests.sparkSession.conf.set(PROVIDER, ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    timed = requests.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed if live else timed.withWatermark(time, late)
    rows = timed.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(time).alias("time"), F.unix_micros(time).alias("micros"))  # names with a leading mark would be lost
    schema = f"tie {kinds[tie]}, key {kinds[key]}, admitted boolean"
    return rows.groupBy("key").transformWithStateInPandas(Admission(limit, seconds, live), schema, "Append", "ProcessingTime" if live else "EventTime").toDF(tie, key, "admitted")
