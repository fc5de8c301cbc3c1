"""The terminal report: at most k rows of each section are collected and printed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from lumenlog.functions.numbers import UNITS
from lumenlog.operators import aggregate as A

TITLES = {
    "remote_addr": "Visitor addresses", "remote_user": "Users", "x_forwarded_for": "Proxy addresses", "request_line": "Requests", "user_agent": "User agents",
    "referer": "Referers", "time_local": "Request times", "status": "Status codes", A.TRAFFIC: "Traffic by request",
}
BLUE, GREEN, RED, PLAIN = "\x1b[1;34m", "\x1b[1;32m", "\x1b[1;31m", "\x1b[00m"


def size(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    i = min((n.bit_length() - 1) // 10, len(UNITS) - 1)
    return f"{n / 1024**i:.2f} {UNITS[i]}"


def share(part: float, whole: float) -> str:
    return f"{part * 100 / whole:.2f}%" if whole else "nan%"


def fit(text: str, width: int) -> str:
    return text[:width].ljust(width)


def render(parsed: DataFrame, width: int = 80, k: int = A.K, color: bool = True) -> Iterator[str]:
    """The report's lines."""
    blue, green, red, plain = (BLUE, GREEN, RED, PLAIN) if color else ("",) * 4
    rows: dict = {}
    for r in A.full_report(parsed, k).collect():  # k rows of each section, one pass over the lines
        rows.setdefault((r.section, r.status), []).append(r)
    of = {name: found[0] for (name, status), found in rows.items() if status is None}
    lines, sent, addresses = (of["status"].total, of[A.TRAFFIC].total, of["remote_addr"].distinct_keys) if of else (0, 0, 0)
    yield f"\n{blue}{lines}{plain} visits\n{green}{size(sent)}{plain} sent\n{red}{addresses}{plain} distinct addresses"
    if not lines:
        return
    wide = max(1, width - 16)

    def section(at: tuple, title: str, traffic: bool = False) -> Iterator[str]:
        text, number = (max(1, wide - 6), 12) if traffic else (wide, 6)
        show = size if traffic else str
        yield f"\n{blue}{title}{plain}"
        foot = rows[at][0]
        for r in sorted(rows[at], key=lambda r: r["rank"]):
            yield f"{fit(r.key, text)} {show(r.n):>{number}} {share(r.n, foot.total)}"
        shown = sum(r.n for r in rows[at])
        yield f"first {k} cover\n{fit(f'{show(shown)}/{show(foot.total)}', text)} {foot.distinct_keys:>{number}} {share(shown, foot.total)}\n"

    for name, _ in A.SECTIONS:
        yield from section((name, None), TITLES[name])
    yield from section((A.TRAFFIC, None), TITLES[A.TRAFFIC], traffic=True)
    for at in sorted((a for a in rows if a[0] == A.NON_200), key=lambda a: a[1]):
        times = rows[at][0].total
        yield from section(at, f"Status {at[1]}: {times} times, {share(times, lines)}")
