"""Ties, empty input, invariants, rendering, sources and streaming."""

import gzip
import io
import sys
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lumenlog import cli
from lumenlog.functions.numbers import human_bytes
from lumenlog.operators import aggregate as A
from lumenlog.operators.parse import parse
from lumenlog.plans.queries import queries
from lumenlog.plans.report import render, share, size
from lumenlog.sources.events_log import event_lines
from lumenlog.sources.lines import read_lines, write_rejects
from lumenlog.streaming.counts import read_stream, windowed_counts


def line(request="GET /", status="200", size="10", ip="1.2.3.4"):
    return f'{ip} - - [10/Oct/2020:13:55:36 +0000] "{request}" {status} {size} "-" "UA" "-"'


def frame(spark, lines):
    return parse(spark.createDataFrame([(v,) for v in lines], "value string"))


def test_ties_are_broken_by_key_descending(spark):
    got = [r.key for r in A.top(frame(spark, [line(f"r{i:03d}") for i in range(150)]), "request_line").collect()]
    assert got == [f"r{i:03d}" for i in reversed(range(50, 150))]


def test_zero_bytes(spark):
    rows = A.traffic(frame(spark, [line("a", size="0"), line("b", size="0")])).collect()
    assert [(r.key, r["bytes"], r.pct) for r in rows] == [("b", 0, None), ("a", 0, None)]


@pytest.mark.parametrize("lines", [[], ["nonsense", ""]])
def test_no_accepted_lines(spark, lines):
    rows = frame(spark, lines)
    assert tuple(A.summary(rows).first()) == (0, 0, 0)
    assert A.report_long(rows).count() == 0
    assert len(list(render(rows))) == 1


def test_invariants_and_one_pass_equals_separate_queries(spark):
    rows = frame(spark, [line(f"r{i % 7}", ["200", "404", "099", "999"][i % 4], str(i), f"1.2.3.{i % 5}") for i in range(200)]).cache()
    total = A.summary(rows).first()
    groups = A.grouped_sections(rows).groupBy("section").agg(F.sum("n").alias("n")).collect()
    for r in groups:
        assert r.n == {A.TRAFFIC: total.total_bytes, A.NON_200: 150}.get(r.section, total.total_lines)
    long = A.report_long(rows, 3)
    for section, field in A.SECTIONS:
        want = [tuple(r) for r in A.top(rows, field, 3).collect()]
        assert [tuple(r) for r in long.where(F.col("section") == section).orderBy("rank").select("key", "n", "pct").collect()] == want
    assert [r.status for r in A.non_200_summary(rows).collect()] == ["099", "404", "999"]
    assert A.non_200_top(rows, 2).groupBy("status").count().where("count != 2").count() == 0


def test_human_bytes_equals_printf(spark):
    values = [0, 1, 1023, 1024, 1152, 1280, 5120 + 128, 1024**2 - 1, 1024**3 * 7 + 12345, 2**62]
    got = dict(spark.createDataFrame([(v,) for v in values], "n long").select("n", human_bytes(F.col("n"))).collect())
    assert got == {v: size(v) for v in values}
    assert share(1, 0) == "nan%" and share(1, 8) == "12.50%"


def test_render_width(spark):
    out = list(render(frame(spark, [line("x" * 200, "404")]), width=40, color=False))
    assert any(row.startswith("x" * 24 + "      1 100.00%") for row in out)
    assert any("Status 404: 1 times, 100.00%" in row for row in out)


def test_line_splitting_and_compressed_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(f"{line()}\r\n{line()} a\rb\n".encode())
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(line().encode())
    assert parse(read_lines(spark, str(tmp_path))).count() == 3
    write_rejects(spark.createDataFrame([("bad",)], "value string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "bad"


def test_cli(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.log").write_text(f"{line()}\nbad\n")
    assert cli.main([str(tmp_path / "a.log")]) == 0
    said = capsys.readouterr()
    assert "1 visits" in said.out and said.err.strip().endswith("bad")
    assert cli.main([str(tmp_path / "none.log")]) == 1
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(f"{line()}\n".encode())))
    assert cli.main([]) == 0


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(f"{line()}\n{line('b')}\nbad\n")
    query = windowed_counts(read_stream(spark, str(tmp_path / "in")), "request_line").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.key, r.n) for r in spark.table("counts").collect()} == {("GET /", 1), ("b", 1)}


def test_full_report_holds_summary_and_footers(spark):
    rows = frame(spark, [line(f"r{i % 7}", ["200", "404", "099", "999"][i % 4], str(i), f"1.2.3.{i % 5}") for i in range(200)]).cache()
    got = {(r.section, r.status): [] for r in A.full_report(rows, 3).collect()}
    for r in A.full_report(rows, 3).orderBy("rank").collect():
        got[(r.section, r.status)].append(r)
    total = A.summary(rows).first()
    assert (got[("status", None)][0].total, got[(A.TRAFFIC, None)][0].total, got[("remote_addr", None)][0].distinct_keys) == tuple(total)
    assert {(at, sum(r.n for r in x), x[0].total, x[0].distinct_keys) for at, x in got.items()} == {((r.section, r.status), r.shown, r.total, r.distinct_keys) for r in A.footers(rows, 3).collect()}


def test_cli_writes_rejects_and_sets_splits(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_text(f"{line()}\nbad\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        assert cli.main([str(tmp_path / "a.log"), "--rejects", str(tmp_path / "out"), "--split-bytes", "65536"]) == 0
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "65536"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["bad"]
    assert "bad" not in capsys.readouterr().err


def test_sizes_beyond_a_long(spark):
    """sf0.1 has some, at which the query failed."""
    sf, unit = "/root/testdata/sf0.1", ("KB", "MB", "GB", "TB", "PB", "EB")
    sums = parse(event_lines(spark, sf)).groupBy("request_line").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    want = {}
    for b in {r.b * r.n * 1000**i + 7 for r in sums for i in range(4)}:
        i = max((i for i in range(1, 7) if b >= 1024**i), default=0)
        cents = round(Fraction(100 * b, 1024**i))  # ties to even
        want[b] = f"{cents // 100}.{cents % 100:02d} {unit[i - 1]}" if i else f"{b} B"
    got = queries()["human_bytes"](spark, sf)
    assert {int(r.bytes): r.text for r in got.collect()} == want and got.count() == len(want) and max(want) > 2**63
    assert dict(queries()["human_bytes"](spark, "/root/testdata/sf0.01").dtypes)["bytes"] == "bigint"
