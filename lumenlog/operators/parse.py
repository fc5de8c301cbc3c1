"""Lines to fields, in one regex evaluation a line and without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.patterns import EXTENDED, EXTENDED_LINE, FIELDS, LINE

MARK = "\x1f"


def _parts(value: Column, pattern: str, n: int) -> Column:
    """The n groups of a line that matches, else fewer than n strings.

    A replacement puts a mark between the groups and a split takes them apart; lines that
    hold the mark themselves are matched group by group instead.
    """
    fast = F.split(F.regexp_replace(value, f"{pattern}[\\s\\S]*+\\z", MARK.join(f"${i}" for i in range(1, n + 1))), MARK)
    slow = F.when(F.rlike(value, F.lit(pattern)), F.array(*[F.regexp_extract(value, pattern, i) for i in range(1, n + 1)])).otherwise(F.array())
    return F.when(F.contains(value, F.lit(MARK)), slow).otherwise(fast)


def attempt(lines: DataFrame, extended: bool = False, strict_status: bool = False) -> DataFrame:
    """value, the fields, bytes, and accepted; fields are null where not accepted.

    A line is accepted if all fields are found and the byte count fits a long; with
    ``strict_status`` the status must also have three digits.
    """
    names = FIELDS + (EXTENDED if extended else ())
    parts = _parts(F.col("value"), EXTENDED_LINE if extended else LINE, len(names))
    # a generator keeps the optimizer from evaluating the regex again in each filter
    rows = lines.select("value", F.explode(F.array(F.struct(parts.alias("p")))).alias("x")).select("value", F.col("x.p").alias("p"))
    get = lambda i: F.get(F.col("p"), F.lit(i))
    number = F.when(F.size("p") == len(names), get(5).try_cast("bigint"))
    accepted = (F.size("p") == len(names)) & number.isNotNull()
    if strict_status:
        accepted &= F.length(get(4)) == 3
    rows = rows.select("value", "p", number.alias("bytes"), F.coalesce(accepted, F.lit(False)).alias("accepted"))
    return rows.select("value", *[F.when(F.col("accepted"), get(i)).alias(c) for i, c in enumerate(names)], F.when(F.col("accepted"), F.col("bytes")).alias("bytes"), "accepted")


def parse(lines: DataFrame, extended: bool = False, strict_status: bool = False) -> DataFrame:
    """The accepted lines' fields, and bytes as a long."""
    return attempt(lines, extended, strict_status).where("accepted").drop("value", "accepted")


def rejects(lines: DataFrame, extended: bool = False, strict_status: bool = False) -> DataFrame:
    """The other lines, as they are."""
    return attempt(lines, extended, strict_status).where("not accepted").select("value")
