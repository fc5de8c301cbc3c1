"""Shares and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def percent(part: Column | str, whole: Column | str) -> Column:
    """part * 100 / whole, unrounded; null where the whole is zero or null."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def human_bytes(n: Column) -> Column:
    """Bytes as text: ``N B`` below 1024, else two decimals, ties to even, as printf has it.

    Takes a long or a decimal without fraction, of up to 34 digits; EB is the largest unit.
    """
    text = F.concat(n.cast("string"), F.lit(" B"))
    for i in range(1, 7):
        unit = F.lit(1024**i).cast("decimal(38,0)")
        scaled = n.cast("decimal(34,0)") * F.lit(100).cast("decimal(3,0)")
        whole = F.floor(scaled / unit).cast("decimal(33,0)")
        twice = (scaled - whole * unit) * 2
        up = (twice > unit) | ((twice == unit) & (whole % 2 == 1))
        cents = (whole + F.when(up, 1).otherwise(0)).cast("decimal(33,0)")
        shown = F.concat(F.expr("''"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {UNITS[i]}"))
        text = F.when(n >= 1024**i, shown).otherwise(text)
    return text
