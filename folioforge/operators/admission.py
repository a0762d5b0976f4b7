"""Admission control: at most ``limit`` admitted requests of a key in a trailing span.

Refused requests don't count, so this is a recursion and not a window frame. Rows of a key
come sorted and are read as a stream: what is held is ``limit`` times of one key, however
many requests a key makes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SECONDS = 10, 3600


class Limiter:
    """The times that count for one key. A request exactly ``seconds`` old still counts."""

    def __init__(self, limit: int = LIMIT, seconds: int = SECONDS, times: list[int] | None = None):
        self.limit, self.span, self.times = limit, seconds * 1_000_000, deque(times or [])

    def admit(self, micros: int) -> bool:
        while self.times and self.times[0] < micros - self.span:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(micros)
        return True


def admit(requests: DataFrame, key: str, time: str, tie: str, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """(tie, key, admitted) of every request, in order of time and then ``tie``; null keys are one key."""
    rows = requests.select(F.col(tie), F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    rows = rows.repartition(key).sortWithinPartitions(key, "_t", tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, book = object(), Limiter(limit, seconds)
        for b in batches:
            out = []
            for k, t in zip(b[key].astype(object).where(b[key].notna(), None), b["_t"], strict=True):
                if k != current:
                    current, book = k, Limiter(limit, seconds)
                out.append(book.admit(t))
            yield pd.DataFrame({tie: b[tie], key: b[key], "admitted": out})

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    return rows.mapInPandas(run, f"`{tie}` {kinds[tie]}, `{key}` {kinds[key]}, admitted boolean")
