"""Counts, sums, shares and deterministic top-k over parsed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.numbers import percent

K = 100
#: Sections of the report that count lines, and the field that each counts by, in print order.
SECTIONS = (
    ("remote_addr", "remote_addr"), ("remote_user", "remote_user"), ("x_forwarded_for", "http_x_forwarded_for"), ("request_line", "request_line"),
    ("user_agent", "http_user_agent"), ("referer", "http_referer"), ("time_local", "time_local"), ("status", "status"),
)
TRAFFIC, NON_200 = "traffic", "non_200"


def summary(parsed: DataFrame) -> DataFrame:
    """Lines, bytes and distinct addresses; zeros for no lines."""
    return parsed.agg(F.count("*").alias("total_lines"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"), F.countDistinct("remote_addr").alias("distinct_ips"))


def _ranked(grouped: DataFrame, value: str, k: int) -> DataFrame:
    """key, value and its share of all groups, the k largest first, ties by key descending."""
    whole = grouped.agg(F.sum(value).alias("whole"))  # one row
    out = grouped.crossJoin(F.broadcast(whole)).select("key", value, percent(value, "whole").alias("pct"))
    return out.orderBy(F.desc(value), F.desc("key")).limit(k)


def frequency(parsed: DataFrame, field: str) -> DataFrame:
    return parsed.groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n"))


def top(parsed: DataFrame, field: str, k: int = K) -> DataFrame:
    """The k commonest values of a field: key, n, pct of all lines."""
    return _ranked(frequency(parsed, field), "n", k)


def traffic(parsed: DataFrame, k: int = K) -> DataFrame:
    """The k request lines of most bytes: key, bytes, pct of all bytes. Zero sums are kept."""
    return _ranked(parsed.groupBy(F.col("request_line").alias("key")).agg(F.sum("bytes").cast("long").alias("bytes")), "bytes", k)


def non_200_summary(parsed: DataFrame) -> DataFrame:
    """status, n, pct of all lines, for each status text other than 200, by status."""
    by = parsed.groupBy("status").agg(F.count("*").alias("n"))
    whole = by.agg(F.sum("n").alias("whole"))
    return by.crossJoin(F.broadcast(whole)).where("status != '200'").select("status", "n", percent("n", "whole").alias("pct")).orderBy("status")


def non_200_top(parsed: DataFrame, k: int = K) -> DataFrame:
    """status, rank, key, n, pct within the status: the k commonest requests of each."""
    by = parsed.where("status != '200'").groupBy("status", F.col("request_line").alias("key")).agg(F.count("*").alias("n"))
    whole = by.groupBy("status").agg(F.sum("n").alias("whole"))
    order = Window.partitionBy("status").orderBy(F.desc("n"), F.desc("key"))
    ranked = by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(whole, "status").select("status", "rank", "key", "n", percent("n", "whole").alias("pct")).orderBy("status", "rank")


def grouped_sections(parsed: DataFrame) -> DataFrame:
    """section, status, key, n: all groups of all sections, in one pass over the lines.

    Every line gives a row for each section and one aggregation counts them; partial sums
    before the shuffle absorb dominant keys. status is null outside the non-200 section.
    """
    none = F.lit(None).cast("string")
    one = lambda section, key: F.struct(F.lit(section).alias("section"), none.alias("status"), F.col(key).alias("key"), F.lit(1).cast("long").alias("v"))
    rows = [one(s, f) for s, f in SECTIONS]
    rows.append(F.struct(F.lit(TRAFFIC).alias("section"), none.alias("status"), F.col("request_line").alias("key"), F.col("bytes").alias("v")))
    rows.append(F.struct(F.when(F.col("status") != "200", F.lit(NON_200)).alias("section"), F.col("status"), F.col("request_line").alias("key"), F.lit(1).cast("long").alias("v")))
    exploded = parsed.select(F.inline(F.array(*rows))).where("section is not null")
    return exploded.groupBy("section", "status", "key").agg(F.sum("v").cast("long").alias("n"))


def report_long(parsed: DataFrame, k: int = K) -> DataFrame:
    """section, status, rank, key, n, pct: the k first rows of every section."""
    groups = grouped_sections(parsed)
    whole = groups.groupBy("section", "status").agg(F.sum("n").alias("whole"))
    order = Window.partitionBy("section", "status").orderBy(F.desc("n"), F.desc("key"))
    ranked = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked, whole = ranked.alias("r"), whole.alias("w")
    same = (F.col("r.section") == F.col("w.section")) & F.col("r.status").eqNullSafe(F.col("w.status"))
    return ranked.join(whole, same).select("r.section", "r.status", "rank", "key", "n", percent("n", "whole").alias("pct"))


def footers(parsed: DataFrame, k: int = K) -> DataFrame:
    """section, status, shown, total, distinct_keys, pct: what the k first rows cover."""
    groups = grouped_sections(parsed)
    order = Window.partitionBy("section", "status").orderBy(F.desc("n"), F.desc("key"))
    shown = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("section", "status").agg(F.sum("n").alias("shown"))
    whole = groups.groupBy("section", "status").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"))
    shown, whole = shown.alias("s"), whole.alias("w")
    same = (F.col("s.section") == F.col("w.section")) & F.col("s.status").eqNullSafe(F.col("w.status"))
    return shown.join(whole, same).select("w.section", "w.status", "shown", "total", "distinct_keys", percent("shown", "total").alias("pct"))


def full_report(parsed: DataFrame, k: int = K) -> DataFrame:
    """section, status, rank, key, n, pct, total, distinct_keys: all that a report prints.

    One pass over the lines and one shuffle of the groups, which both sides of the join
    reuse; the totals of lines, bytes and addresses are those of their sections.
    """
    groups = grouped_sections(parsed)
    whole = groups.groupBy("section", "status").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"))
    order = Window.partitionBy("section", "status").orderBy(F.desc("n"), F.desc("key"))
    ranked = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked, whole = ranked.alias("r"), whole.alias("w")
    same = (F.col("r.section") == F.col("w.section")) & F.col("r.status").eqNullSafe(F.col("w.status"))
    return ranked.join(whole, same).select("r.section", "r.status", "rank", "key", "n", percent("n", "total").alias("pct"), "total", "distinct_keys")
