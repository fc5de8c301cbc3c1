"""Golden lines, and the regex against a byte-wise scanner on mutated lines."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.patterns import EXTENDED, FIELDS
from lumenlog.operators.parse import attempt, parse, rejects

REST = '[t] "GET / HTTP/1.1" 200 612 "-" "UA" "-"'
GOOD = ["1.2.3.4", "-", "t", "GET / HTTP/1.1", "200", "612", "-", "UA", "-"]


def but(**changes):
    return [changes.get(f"f{i}", v) for i, v in enumerate(GOOD)]


GOLDEN = {
    f"1.2.3.4 - - {REST}": GOOD,
    f"1.2.3.4 - bob {REST}": but(f1="bob"),
    f"1.2.3.4 - -bob {REST}": but(f1="-bob"),
    f"1.2.3.4 --bob {REST}": but(f1="bob"),
    f"1.2.3.4- bob {REST}": but(f1="bob"),
    f"::1 - - {REST}": but(f0="::1"),
    f"2001:DB8::1 - - {REST}": None,
    f"   1.2.3.4 - - {REST}": GOOD,
    f"unix: - - {REST}": None,
    f"bad - - {REST}": but(f0="bad"),
    f"1.2.3.4 - john doe {REST}": None,
    '1.2.3.4 - [t] "GET /" 200 1 "-" "U" "-"': None,
    '1.2.3.4 - - [t] "" 400 0 "" "" ""': ["1.2.3.4", "-", "t", "", "400", "0", "", "", ""],
    '1.2.3.4 - - [t]"G"200 5"-""U""-"': None,
    '1.2.3.4 - - [t]"G"200 5 "-""U""-"': ["1.2.3.4", "-", "t", "G", "200", "5", "-", "U", "-"],
    '1.2.3.4 - - [t] "G" 200 - "-" "U" "-"': None,
    '1.2.3.4 - - [t] "G" 200 5 "-" "U"': None,
    f"1.2.3.4 - - {REST} 0.003 host extra": GOOD,
    '1.2.3.4 - - [t] "G" 2000 5 "-" "U" "-"': ["1.2.3.4", "-", "t", "G", "2000", "5", "-", "U", "-"],
    '1.2.3.4 - - [t] "G" 99 5 "-" "U" "-"': ["1.2.3.4", "-", "t", "G", "99", "5", "-", "U", "-"],
    '1.2.3.4 - - [t] "G" 200/5 "-" "U" "-"': ["1.2.3.4", "-", "t", "G", "200", "5", "-", "U", "-"],
    '1.2.3.4 - - [t] "G \\"x\\"" 200 5 "-" "U" "-"': None,
    "": None,
    '1.2.3.4 - - [t] "G" 200 99999999999999999999 "-" "U" "-"': None,
    '1.2.3.4 - - [t] "a\x1fb" 200 5 "-" "U" "-"': ["1.2.3.4", "-", "t", "a\x1fb", "200", "5", "-", "U", "-"],
    "\x1f" * 8: None,
}


def scan(line):
    """The format's scanner, byte by byte."""
    at, out = 0, []

    def spaces():
        nonlocal at
        while at < len(line) and line[at] == " ":
            at += 1

    def run(fits):
        nonlocal at
        spaces()
        start = at
        while at < len(line) and fits(line[at]):
            at += 1
        if at == start:
            raise ValueError
        out.append(line[start:at])
        at += at < len(line)
        spaces()

    def wrapped(left, right):
        nonlocal at
        spaces()
        if at >= len(line) or line[at] != left or (end := line.find(right, at + 1)) < 0:
            raise ValueError
        out.append(line[at + 1 : end])
        at = end + 1

    try:
        run(lambda c: c in "0123456789:.abcdef")
        while at < len(line) and line[at] == "-":
            at += 1
        run(lambda c: c != " ")
        wrapped("[", "]")
        wrapped('"', '"')
        run(str.isdigit)
        run(str.isdigit)
        for _ in range(3):
            wrapped('"', '"')
    except ValueError:
        return None
    return out if int(out[5]) < 1 << 63 else None


def parsed(spark, lines):
    rows = attempt(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    return {r.value: [r[c] for c in FIELDS] if r.accepted else None for r in rows}


def test_golden_lines(spark):
    assert parsed(spark, GOLDEN) == GOLDEN


def test_mutations_equal_scanner(spark):
    rng, lines = random.Random(7), set()
    seeds = [v for v in GOLDEN if v]
    while len(lines) < 4000:
        line = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(line) or 1)
            line[i : i + rng.randint(0, 2)] = rng.choice(["", " ", '"', "-", "[", "]", "7", "a", "\x1f", "  ", "/"])
        lines.add("".join(line))
    assert parsed(spark, lines) == {v: scan(v) for v in lines}


def test_accepted_and_rejected_are_all_lines(spark):
    lines = spark.createDataFrame([(v,) for v in GOLDEN] * 2, "value string")
    assert parse(lines).count() + rejects(lines).count() == lines.count()
    assert attempt(lines, strict_status=True).where("accepted and length(status) != 3").count() == 0


@pytest.mark.parametrize(("suffix", "fields"), [("example.com 512 1024 10.0.0.1:80 502, 200 0.123 0.120 - 0.119", ["example.com", "512", "1024", "10.0.0.1:80", "502, 200", "0.123", "0.120", "-", "0.119"]), ("h 1 2 u - 0.1 - - -", ["h", "1", "2", "u", "-", "0.1", "-", "-", "-"])])
def test_extended_fields(spark, suffix, fields):
    row = parse(spark.createDataFrame([(f"1.2.3.4 - - {REST} {suffix}",)], "value string"), extended=True).select(*EXTENDED).first()
    assert list(row) == fields


def test_regex_is_evaluated_once(spark):
    plan = parse(spark.range(1).select(F.col("id").cast("string").alias("value")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "Python" not in plan
