"""The line format as regular expressions for Spark's regex engine.

A field is a maximal run of bytes of its class; the byte that ends the run is consumed
whatever it is, and nothing is ever given back. Possessive quantifiers say exactly that.
"""

from __future__ import annotations

FIELDS = ("remote_addr", "remote_user", "time_local", "request_line", "status", "body_bytes_sent", "http_referer", "http_user_agent", "http_x_forwarded_for")
EXTENDED = ("host", "request_length", "bytes_sent", "upstream_addr", "upstream_status", "request_time", "upstream_response_time", "upstream_connect_time", "upstream_header_time")

# The byte classes of the format's fields.
DIGITS = "[0-9]"
DIGITS_DOT = "[0-9.]"
ADDRESS = "[0-9:.a-f]"
DIGITS_DOT_MINUS = "[0-9.\\-]"
NOT_SPACE = "[^ ]"
# a space ends a status list only after a digit or a dash
STATUS_LIST = "(?:[^ ]|(?<![0-9-]) )"

CONSUMED = "[\\x00-\\x7F]?+ *+"  # the byte that ended a run, then spaces


def run(byte_class: str) -> str:
    return f"({byte_class}++)"


def wrapped(left: str, right: str) -> str:
    """Spaces, a left mark, and everything up to the first right mark."""
    return f" *+{left}([^{right}]*+){right}"


QUOTED = wrapped('"', '"')
LINE = (
    f"\\A *+{run(ADDRESS)}{CONSUMED}-*+ *+{run(NOT_SPACE)}{CONSUMED.removesuffix(' *+')}{wrapped('\\[', '\\]')}{QUOTED}"
    f" *+{run(DIGITS)}{CONSUMED}{run(DIGITS)}{CONSUMED.removesuffix(' *+')}{QUOTED}{QUOTED}{QUOTED}"
)
CLASSES = (NOT_SPACE, DIGITS, DIGITS, NOT_SPACE, STATUS_LIST, DIGITS_DOT, DIGITS_DOT_MINUS, DIGITS_DOT_MINUS, DIGITS_DOT_MINUS)
EXTENDED_LINE = LINE + " *+" + CONSUMED.join(run(c) for c in CLASSES)
