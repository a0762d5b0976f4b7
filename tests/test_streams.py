"""Streams that are stopped, restarted and tried again."""

import datetime as dt
import time

import pytest

from folioforge.streaming.admission import admit_stream
from folioforge.streaming.usage import append_stream, usage_rows, whole_batches, write_once

T0 = dt.datetime(2026, 1, 1)
USAGE = "id long, note string"


def feed(spark, folder, part, ids):
    spark.createDataFrame([(i, f"a;{i}") for i in ids], USAGE).coalesce(1).write.parquet(f"{folder}/p{part}")


def stream(spark, folder):
    return spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_usage_survives_restarts(spark, tmp_path):
    folder, path = str(tmp_path / "in"), f"file://{tmp_path}/usage"
    assert usage_rows(spark, path, USAGE).count() == 0
    feed(spark, folder, 0, range(5))
    feed(spark, folder, 1, range(5, 9))
    append_stream(stream(spark, folder), path, f"{tmp_path}/c").awaitTermination()
    assert whole_batches(spark, path).count() == 2
    append_stream(stream(spark, folder), path, f"{tmp_path}/c").awaitTermination()
    feed(spark, folder, 2, range(9, 12))
    append_stream(stream(spark, folder), path, f"{tmp_path}/c").awaitTermination()
    append_stream(stream(spark, folder), path, f"{tmp_path}/lost").awaitTermination()  # all batches again
    got = usage_rows(spark, path, USAGE).collect()
    assert sorted(r["id"] for r in got) == list(range(12)) and {r["note"] for r in got} == {f"a {i}" for i in range(12)}


def test_a_batch_that_was_cut_off_is_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/usage"
    spark.createDataFrame([(1, "half")], USAGE).write.parquet(f"{path}/rows/batch=7")  # its id never came
    assert usage_rows(spark, path, USAGE).count() == 0
    whole = spark.createDataFrame([(1, "x"), (2, "y")], USAGE)
    for _ in range(2):
        write_once(path)(whole, 7)
    assert sorted((r["id"], r["batch"]) for r in usage_rows(spark, path, USAGE).collect()) == [(1, 7), (2, 7)]


@pytest.mark.parametrize("live", [False, True])
def test_silent_keys_leave_no_state(spark, tmp_path, live):
    """Each file holds a key of its own, a day after the one before; under the clock entries live for a second."""
    for part in range(5):
        rows = [(10 * part + i, f"k{part}", T0 + dt.timedelta(days=part, seconds=i)) for i in range(4)]
        spark.createDataFrame(rows, "id long, key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    source = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    told = admit_stream(source, "key", "ts", "id", limit=3, seconds=1 if live else 60, live=live)
    query = told.writeStream.format("memory").queryName(f"silent_{live}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    ends = time.monotonic() + 60  # by the clock batches never end, so that the stream is asked until all rows are there
    while time.monotonic() < ends and spark.table(f"silent_{live}").count() < 20 and query.isActive:
        time.sleep(0.5)
    held = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"]
    while live and time.monotonic() < ends and held() > 0:
        time.sleep(0.5)
    assert not live or held() == 0
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    admitted = {r["id"]: r["admitted"] for r in spark.table(f"silent_{live}").collect()}
    assert len(admitted) == 20 and (live or all(a == (i % 10 < 3) for i, a in admitted.items()))
    if not live:  # a batch sets the watermark that the next one clears by
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) < 20 and progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2 * (3 + 2)
