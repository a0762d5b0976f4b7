import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioforge.errors import SelectionError
from folioforge.operators import service as S
from folioforge.operators.admission import Limiter, admit
from folioforge.operators.selection import parse_selection, require_minimum, selection_frame
from folioforge.streaming.admission import admit_stream

T0 = dt.datetime(2026, 1, 1)


def test_limiter_counts_admitted_requests_only():
    book = Limiter(limit=2, seconds=10)
    assert [book.admit(t * 1_000_000) for t in (0, 1, 2, 10, 11, 12)] == [True, True, False, False, True, True]


def requests(n=40):
    return [(i, "k" if i % 3 else None, T0 + dt.timedelta(seconds=(i * 7) % 90)) for i in range(n)]


def expected(rows, limit, seconds):
    books, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = books.setdefault(k, Limiter(limit, seconds)).admit(int((t - T0).total_seconds()) * 1_000_000)
    return out


def test_batch_admission(spark):
    df = spark.createDataFrame(requests(), "id long, key string, ts timestamp")
    got = {r["id"]: r["admitted"] for r in admit(df, "key", "ts", "id", limit=3, seconds=20).collect()}
    assert got == expected(requests(), 3, 20)
    assert admit(df.limit(0), "key", "ts", "id").count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = sorted((r for r in requests() if r[1]), key=lambda r: (r[2], r[0]))
    for part, own in enumerate((rows[:12], rows[12:])):
        spark.createDataFrame(own, "id long, key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = admit_stream(source, "key", "ts", "id", limit=3, seconds=20).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: r["admitted"] for r in spark.table("admitted").collect()}
    assert got == expected(rows, 3, 20)


def test_selections(spark):
    assert parse_selection("1 Samuel 1,3-5;2sam 2\nRut 1") == {"1 Samuel": [1, 3, 4, 5], "2 Samuel": [2], "Rut": [1]}
    for bad in ("", "Samuel 1", "1 Samuel", "1 Samuel 0", "1 Samuel 5-3", "1 Samuel 1-99999999999", "1 Samuel 151", "1 Samuel 1-2-3"):
        with pytest.raises(SelectionError):
            parse_selection(bad)
    assert parse_selection("1 Samuel 150") == {"1 Samuel": [150]}
    with pytest.raises(SelectionError):
        require_minimum({"Rut": [1], "Ioan": [2]})
    df = spark.createDataFrame([(1, "1 sam 1,3-4;rut 2"), (2, "Ioan 1,1")], "id int, selection string")
    assert {tuple(r) for r in selection_frame(df).collect()} == {(1, "1 Samuel", 1), (1, "1 Samuel", 3), (1, "1 Samuel", 4), (1, "Rut", 2), (2, "Ioan", 1)}
    with pytest.raises(Exception, match="Interval"):
        selection_frame(spark.createDataFrame([("Rut 1-999",)], "selection string")).collect()


def test_request_fields(spark):
    df = spark.createDataFrame([("a=1&b=x%20y&a=2&c=", " 1.1.1.1 , 2", "9.9.9.9", True), ("", None, "9.9.9.9", True), ("z", "1.1.1.1", "9.9.9.9", False)], "body string, fwd string, peer string, trusted boolean")
    rows = df.select(S.form_fields(F.col("body")).alias("f"), S.caller(F.col("fwd"), F.col("peer"), F.col("trusted")).alias("c")).collect()
    assert [r["f"] for r in rows] == [{"a": "2", "b": "x y"}, {}, {}] and [r["c"] for r in rows] == ["1.1.1.1", "9.9.9.9", "9.9.9.9"]
    one = spark.createDataFrame([("a;b\nc", " 7 ", "")], "t string, n string, m string")
    assert tuple(one.select(S.clean_field(F.col("t")), S.int_field(F.col("n"), 1), S.int_field(F.col("m"), 5)).first()) == ("a b c", 7, 5)


def test_retention(spark, tmp_path):
    rows = [(f"e{i}", T0 + dt.timedelta(hours=i // 2), i != 4, i == 0) for i in range(6)]
    df = spark.createDataFrame(rows, "name string, mtime timestamp, has_test_json boolean, protected boolean")
    assert {r["name"] for r in S.outdated(df, 2).collect()} == {"e1", "e2", "e3"} - {"e2"}
    sessions = spark.createDataFrame([("abcdefghijkl", True), ("abc", True), ("abcdefghijkm", False)], "name string, has_version_json boolean")
    assert [r["name"] for r in S.web_sessions(sessions).collect()] == ["abcdefghijkl"]
    S.append_usage(spark.createDataFrame([("1.1.1.1", "a;b")], "ip string, selection string"), str(tmp_path / "u"))
    S.append_usage(spark.createDataFrame([("1.1.1.1", "c")], "ip string, selection string"), str(tmp_path / "u"))
    assert {r["selection"] for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {"a b", "c"}
