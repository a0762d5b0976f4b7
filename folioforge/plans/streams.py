"""Streams over the standard tables that end when all of it is read, each beside its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.plans.catalogue import ORACLES, _query, _read
from folioforge.streaming.admission import admit_stream
from folioforge.streaming.usage import append_stream, usage_rows
from folioforge.tables import shared_dir


def _stream(spark, sf_dir, name):
    # a pattern, since a table may be one file, which a stream reads only as a match
    return spark.readStream.schema(_read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


@_query(ORACLES["admission_limit"])
def admission_replay(spark, sf_dir):
    """The events as a stream of requests: which ones the limiter admits."""
    at = f"{shared_dir(spark)}/admission-{uuid.uuid4().hex}"
    events = _stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    told = admit_stream(events, "user_id", "ts", "event_id", limit=5, seconds=86_400).writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
    told.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, admitted boolean").parquet(f"{at}/rows")


@_query("SELECT event_type, user_id, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY ALL")
def usage_once(spark, sf_dir):
    """Events appended by a stream that is started twice from one checkpoint and once from none, counted by type and user."""
    at = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    events = _stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for checkpoint in ("state", "state", "lost"):  # after the third all batches are tried again, by the same ids
        append_stream(events, f"{at}/usage", f"{at}/{checkpoint}").awaitTermination()
    rows = usage_rows(spark, f"{at}/usage", "event_id long, user_id long, event_type string")
    return rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_distinct"))
