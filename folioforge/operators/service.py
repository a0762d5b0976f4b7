"""What a service around the engine asks of tables: who calls, what they sent, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def caller(forwarded: Column, peer: Column, trusted: Column) -> Column:
    """The first forwarded address if the proxy is trusted and gave one, else the peer's."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(trusted & (F.coalesce(first, F.lit("")) != ""), first).otherwise(peer)


def clean_field(value: Column) -> Column:
    """Record marks (line ends and ;) become blanks."""
    return F.trim(F.regexp_replace(value, "[\r\n;]", " "))


def int_field(value: Column, default: int) -> Column:
    """The number; blank or missing gives the default, anything else an error."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    number = bare.try_cast("int")
    return F.when(bare == "", F.lit(default)).when(number.isNull(), F.raise_error(F.concat(F.lit("Valoare numerică invalidă: "), bare)).cast("int")).otherwise(number)


def form_fields(body: Column, most: int = 32) -> Column:
    """URL-encoded fields as a map: blanks dropped, the last value of a name wins."""
    pair = lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("key"), F.url_decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.char_length(p))).otherwise("")).alias("value"))
    pairs = F.filter(F.transform(F.slice(F.split(body, "&"), 1, most), pair), lambda p: p["value"] != "")
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(names, last)


def outdated(entries: DataFrame, keep: int) -> DataFrame:
    """Generated entries beyond the ``keep`` most recent, but for protected ones.

    ``entries`` are (name, mtime, has_test_json, protected) in one folder; (folder too, if there
    are several). Equal times go by name.
    """
    by = [c for c in ("folder",) if c in entries.columns]
    order = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(F.desc("mtime"), "name")
    ranked = entries.where("has_test_json").withColumn("_r", F.row_number().over(order))
    return ranked.where((F.col("_r") > keep) & ~F.col("protected")).drop("_r")


def web_sessions(entries: DataFrame) -> DataFrame:
    """Entries named by a 12-character token that hold a version's test.json."""
    return entries.where(F.regexp_like("name", F.lit("^[A-Za-z0-9_-]{12}$")) & F.col("has_version_json"))


def append_usage(events: DataFrame, path: str) -> None:
    """Usage events as an append-only table; text fields are cleaned of record marks."""
    text = [f.name for f in events.schema.fields if f.dataType.simpleString() == "string"]
    events.withColumns({c: clean_field(F.col(c)) for c in text}).write.mode("append").parquet(path)
