"""Registered queries of the access-log engine and their SQL twins.

The twins build the same lines, parse them with a pattern of their own for DuckDB's
engine, and aggregate in plain SQL.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.numbers import human_bytes
from lumenlog.functions.patterns import EXTENDED, FIELDS
from lumenlog.operators import aggregate as A
from lumenlog.operators.parse import attempt, parse, rejects
from lumenlog.sources.events_log import DUCKDB, event_lines, line_sql
from lumenlog.sources.lines import read_lines

TOPS = {f"top_{section}": field for section, field in A.SECTIONS}


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_lines(spark, sf_dir))


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempt(event_lines(spark, sf_dir).select(F.regexp_replace("value", '" 304 ', '" 3040 ').alias("value")), strict_status=True)
    return rows.select("value", "accepted", "status", "bytes").groupBy("value", "accepted", "status", "bytes").agg(F.count("*").alias("n"))


def _path(spark: SparkSession) -> str:
    """A new name in the session's shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lumenlog-")
    return f"{folder}/lumenlog-{uuid.uuid4().hex}"


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, written as text files to the session's shared folder and read again."""
    path = _path(spark)
    event_lines(spark, sf_dir).select("value").write.text(path, lineSep="\n")
    return read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.full_report(_parsed(spark, sf_dir))


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_lines(spark, sf_dir, extended=True), extended=True).groupBy(*EXTENDED).agg(F.count("*").alias("n"))


def _human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes made from the lines' bytes, and their texts.

    Sizes are reckoned in decimals of 34 digits. Their column is a long, as in SQL, while all
    fit one; else, where SQL fails for that, it is a decimal that holds every size.
    """
    total = F.sum(F.col("bytes").cast("decimal(19,0)")) * F.count("*").cast("decimal(19,0)")
    sums = _parsed(spark, sf_dir).groupBy("request_line").agg(total.cast("decimal(34,0)").alias("bytes"))
    made = F.array(*[(F.col("bytes") * F.lit(1000**i).cast("decimal(10,0)") + 7).cast("decimal(34,0)") for i in range(4)])
    path = _path(spark)  # written once, as its largest size says its type
    sums.select(F.explode(made).alias("bytes")).distinct().write.parquet(path)
    sizes = spark.read.parquet(path)
    most = sizes.agg(F.max("bytes")).first()[0]
    if most is None or most < 1 << 63:
        sizes = sizes.select(F.col("bytes").cast("long").alias("bytes"))
    return sizes.select("bytes", human_bytes(F.col("bytes")).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "parse_accepted": lambda s, d: _parsed(s, d).select(*FIELDS, "bytes"),
        "parse_rejects": lambda s, d: rejects(event_lines(s, d)).groupBy("value").agg(F.count("*").alias("n")),
        "parse_strict_status": _strict,
        "scan_text": _scanned,
        "full_report": _full,
        "extended_fields": _extended,
        "summary": lambda s, d: A.summary(_parsed(s, d)),
        "traffic_by_request": lambda s, d: A.traffic(_parsed(s, d)),
        "status_non200_summary": lambda s, d: A.non_200_summary(_parsed(s, d)),
        "status_non200_top": lambda s, d: A.non_200_top(_parsed(s, d)),
        "report_long": lambda s, d: A.report_long(_parsed(s, d)),
        "section_footers": lambda s, d: A.footers(_parsed(s, d)),
        "human_bytes": _human,
    }
    for name, field in TOPS.items():
        out[name] = lambda s, d, field=field: A.top(_parsed(s, d), field)
    return out


_RE2 = (
    r'\A *([0-9:.a-f]+)[^0-9:.a-f] *(-+ +[^ ]+|-*[^ -][^ ]*) +\[([^\]]*)\] *"([^"]*)" *([0-9]+)[\x00-\x2f\x3a-\x7f] *([0-9]+)[\x00-\x2f\x3a-\x7f] *"([^"]*)"'
    r' *"([^"]*)" *"([^"]*)"'
)


def _with(lines: str, extra: str = "true") -> str:
    groups = ", ".join(f"regexp_extract(value, p, {i}) AS {c}" if c != "remote_user" else f"regexp_replace(regexp_extract(value, p, {i}), '\\A-* *', '') AS {c}" for i, c in enumerate(FIELDS, 1))
    return f"""WITH raw AS (SELECT event_id, {lines} AS value FROM events),
    matched AS (SELECT *, regexp_matches(value, p) AS ok FROM (SELECT *, '{_RE2}' AS p FROM raw)),
    tried AS (SELECT *, {groups} FROM matched),
    judged AS (SELECT *, try_cast(body_bytes_sent AS BIGINT) AS bytes, coalesce(ok AND try_cast(body_bytes_sent AS BIGINT) IS NOT NULL AND {extra}, false) AS accepted FROM tried),
    parsed AS (SELECT * FROM judged WHERE accepted)"""


def _top(source: str, value: str, k: int = A.K) -> str:
    return f"""SELECT key, {value}, CAST({value} AS DOUBLE) * 100.0::DOUBLE / nullif((SELECT sum({value}) FROM {source}), 0)::DOUBLE AS pct
    FROM {source} ORDER BY {value} DESC, key DESC LIMIT {k}"""


def _groups() -> str:
    parts = [f"SELECT '{s}' AS section, CAST(NULL AS VARCHAR) AS status, {f} AS key, CAST(count(*) AS BIGINT) AS n FROM parsed GROUP BY {f}" for s, f in A.SECTIONS]
    parts.append(f"SELECT '{A.TRAFFIC}', CAST(NULL AS VARCHAR), request_line, CAST(sum(bytes) AS BIGINT) FROM parsed GROUP BY request_line")
    parts.append(f"SELECT '{A.NON_200}', status, request_line, CAST(count(*) AS BIGINT) FROM parsed WHERE status <> '200' GROUP BY status, request_line")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    base = _with(line_sql(DUCKDB))
    strict = _with(f"replace({line_sql(DUCKDB)}, '\" 304 ', '\" 3040 ')", "length(status) = 3")
    longer = _with(line_sql(DUCKDB, extended=True))
    ranked = f""", g AS ({_groups()}), r AS (SELECT *, row_number() OVER (PARTITION BY section, status ORDER BY n DESC, key DESC) AS rk, sum(n) OVER (PARTITION BY section, status) AS whole,
      count(*) OVER (PARTITION BY section, status) AS kinds FROM g)"""
    unit = "CASE " + " ".join(f"WHEN bytes >= {1024**i} THEN printf('%.2f', bytes / {1024**i}::DOUBLE) || ' {u}'" for i, u in reversed(list(enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1)))) + " ELSE bytes || ' B' END"
    # the extended fields are stated from their source, not parsed
    source = {
        "host": "'h' || (event_id % 5) || '.example.com'", "request_length": "(event_id % 900)::VARCHAR", "bytes_sent": "(event_id % 700)::VARCHAR", "upstream_addr": "'10.1.0.' || (event_id % 9) || ':80'",
        "upstream_status": "CASE WHEN event_id % 7 = 0 THEN '502, 200' ELSE '200' END", "request_time": "'0.' || (event_id % 90)", "upstream_response_time": "'0.' || (event_id % 80)",
        "upstream_connect_time": "'-'", "upstream_header_time": "'0.' || (event_id % 70)",
    }
    out = {
        "parse_accepted": f"{base} SELECT {', '.join(FIELDS)}, bytes FROM parsed",
        "parse_rejects": f"{base} SELECT value, count(*) AS n FROM judged WHERE NOT accepted GROUP BY value",
        "parse_strict_status": f"{strict}, rows AS (SELECT value, accepted, CASE WHEN accepted THEN status END AS status, CASE WHEN accepted THEN bytes END AS bytes FROM judged) SELECT value, accepted, status, bytes, count(*) AS n FROM rows GROUP BY ALL",
        "scan_text": f"{base} SELECT value, count(*) AS n FROM raw GROUP BY value",
        "full_report": f"{base}{ranked} SELECT section, status, CAST(rk AS INTEGER) AS rank, key, n, CAST(n AS DOUBLE) * 100.0::DOUBLE / nullif(whole, 0)::DOUBLE AS pct, CAST(whole AS BIGINT) AS total, kinds AS distinct_keys FROM r WHERE rk <= {A.K}",
        "extended_fields": f"{longer} SELECT {', '.join(source[c] + ' AS ' + c for c in EXTENDED)}, count(*) AS n FROM parsed GROUP BY {', '.join(map(str, range(1, 10)))}",
        "summary": f"{base} SELECT count(*) AS total_lines, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, count(DISTINCT remote_addr) AS distinct_ips FROM parsed",
        "traffic_by_request": f"{base}, t AS (SELECT request_line AS key, CAST(sum(bytes) AS BIGINT) AS bytes FROM parsed GROUP BY request_line) {_top('t', 'bytes')}",
        "status_non200_summary": f"{base} SELECT status, count(*) AS n, CAST(count(*) AS DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM parsed)::DOUBLE AS pct FROM parsed WHERE status <> '200' GROUP BY status",
        "status_non200_top": f"{base}{ranked} SELECT status, CAST(rk AS INTEGER) AS rank, key, n, CAST(n AS DOUBLE) * 100.0::DOUBLE / whole::DOUBLE AS pct FROM r WHERE section = '{A.NON_200}' AND rk <= {A.K}",
        "report_long": f"{base}{ranked} SELECT section, status, CAST(rk AS INTEGER) AS rank, key, n, CAST(n AS DOUBLE) * 100.0::DOUBLE / nullif(whole, 0)::DOUBLE AS pct FROM r WHERE rk <= {A.K}",
        "section_footers": f"""{base}{ranked} SELECT section, status, CAST(sum(n) AS BIGINT) AS shown, CAST(max(whole) AS BIGINT) AS total, CAST(max(kinds) AS BIGINT) AS distinct_keys,
          CAST(sum(n) AS DOUBLE) * 100.0::DOUBLE / nullif(max(whole), 0)::DOUBLE AS pct FROM r WHERE rk <= {A.K} GROUP BY section, status""",
        "human_bytes": f"""{base}, sums AS (SELECT CAST(sum(bytes) * count(*) AS BIGINT) AS b FROM parsed GROUP BY request_line),
          sizes AS (SELECT DISTINCT unnest([b + 7, b * 1000 + 7, b * 1000000 + 7, b * 1000000000 + 7]) AS bytes FROM sums) SELECT bytes, {unit} AS text FROM sizes""",
    }
    for name, field in TOPS.items():
        out[name] = f"{base}, t AS (SELECT {field} AS key, count(*) AS n FROM parsed GROUP BY {field}) {_top('t', 'n')}"
    return out
