"""Access-log lines made from the driver's events table, textually equal in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINE = """concat(
 case when event_id % 10 = 3 then concat('2001:db8::', cast(user_id as {text})) else concat('10.', cast(event_id % 4 as {text}), '.0.', cast(user_id % 250 as {text})) end,
 ' - ', case when event_id % 5 = 0 then concat('user', cast(user_id as {text})) else '-' end,
 ' [', {time}, ' +0000] "',
 case when event_id % 40 = 7 then '' else concat('GET /', event_type, '/', cast(event_id % 37 as {text}), ' HTTP/1.1') end, '" ',
 case when event_id % 40 = 7 then '400' when event_type = 'error' then (case when event_id % 2 = 0 then '500' else '502' end) when event_id % 11 = 0 then '404' when event_id % 13 = 0 then '304' else '200' end, ' ',
 case when event_id % 23 = 0 then '-' when event_id % 13 = 0 then '0' else cast(cast(floor(value * 100) as bigint) as {text}) end,
 ' "', case when event_id % 3 = 0 then '-' when event_id % 3 = 1 then concat('https://example.com/', event_type) else '' end,
 '" "Mozilla/5.0 (synthetic) Agent/', cast(user_id % 7 as {text}), '"',
 case when event_id % 17 = 0 then '' when event_id % 4 = 0 then concat(' "203.0.113.', cast(user_id % 20 as {text}), ', 10.0.0.1"') else ' "-"' end{tail})"""
_TAIL = ",\n case when event_id % 6 = 0 then ' 0.123 extra' else '' end"
_EXTENDED = """,
 ' h', cast(event_id % 5 as {text}), '.example.com ', cast(event_id % 900 as {text}), ' ', cast(event_id % 700 as {text}), ' 10.1.0.', cast(event_id % 9 as {text}), ':80 ',
 case when event_id % 7 = 0 then '502, 200' else '200' end, ' 0.', cast(event_id % 90 as {text}), ' 0.', cast(event_id % 80 as {text}), ' - 0.', cast(event_id % 70 as {text}), ' rest'"""
SPARK = {"text": "string", "time": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')"}
DUCKDB = {"text": "varchar", "time": "strftime(ts, '%d/%b/%Y:%H:%M:%S')"}


def line_sql(dialect: dict[str, str], extended: bool = False) -> str:
    line = _LINE.format(**dialect, tail=_EXTENDED.format(**dialect) if extended else _TAIL)
    return f"case when event_id % 29 = 0 then '' else {line} end"


def event_lines(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{line_sql(SPARK, extended)} as value")
