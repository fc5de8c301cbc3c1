"""Personal data replaced by format-preserving Feistel pseudonyms.

Mail addresses, telephone and payment-card numbers, IBANs, social security numbers, IP
addresses and dates are found, validated (check digits, ranges, the calendar) and
permuted with a keyed Feistel network inside the set of values of their own format, so a
value keeps its shape and validity and equal values get equal pseudonyms in every
document. Numbers that fail validation, and all other text, stay as they are.

Defined results: null text stays null with no replacements; no value is its own
pseudonym; repeated rows stay; null ids stay; columns besides the text pass through
``pseudonymised`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from ipaddress import AddressValueError, IPv4Address, IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import add_columns

ROUNDS = 8
#: Used where a caller gives no key; production callers give their own secret.
DEFAULT_KEY = b"lumenlog-example-key"
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# Month names in English, German, French and Spanish; country calling codes of
# one and two digits (all others have three).
MONTHS = (
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
)
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
MONTH = "|".join(sorted({w for m in MONTHS for n in m for w in (n, n.capitalize(), n.upper())}, key=lambda n: (-len(n), n)))

HINT = re.compile(r"[0-9@]")
PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.+%-])\w[\w.+%'-]{{0,63}}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,}})
  | (?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
  | (?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{1,4}}|(?=[A-Fa-f:]{{0,32}}[0-9])(?:[0-9A-Fa-f]{{1,4}}:){{1,7}}:)(?![\w:]))
  | (?P<ip>(?<![\w.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\w|\.[0-9]))
  | (?P<ymd>(?<![\w/.-])[0-9]{{4}}(?P<s1>[-/.])[0-9]{{1,2}}(?P=s1)[0-9]{{1,2}}(?![\w/-]|\.[0-9]))
  | (?P<dmy>(?<![\w/.-])[0-9]{{1,2}}(?P<s2>[-/.])[0-9]{{1,2}}(?P=s2)[0-9]{{4}}(?![\w/-]|\.[0-9]))
  | (?P<named>(?<!\w)(?:[0-9]{{1,2}}\.?[ ](?:de[ ])?(?:{MONTH})[ ](?:de[ ])?[0-9]{{4}}|(?:{MONTH})[ ][0-9]{{1,2}},[ ][0-9]{{4}})(?!\w))
  | (?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
  | (?P<card>(?<![\w+.-])[0-9](?:[ -]?[0-9]){{12,18}}(?!\w|-[0-9]))
  | (?P<phone>(?<![\w+.-])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3,4}}[ .-][0-9]{{4}}(?!\w|-[0-9]))
  | (?P<intl>(?<![\w+.-])\+[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{2,4}}\)?){{2,5}}(?!\w|-[0-9]))
""",
    re.X,
)
TOKEN = re.compile(r"\w+|\W")
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
PLACE = {c: (alphabet, i) for alphabet in ALPHABETS for i, c in enumerate(alphabet)}


def luhn(digits: str) -> int:
    """Check sum of a number; 0 for a valid one."""
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    """Keyed permutations of sets 0..n-1 without fixed points, and formats upon them."""

    def __init__(self, key: bytes = DEFAULT_KEY):
        self.key = blake2b(key, digest_size=32).digest()
        self.replace = lru_cache(65_536)(self._replace)

    def noise(self, tweak: str, turn: int, half: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{turn}|{half}".encode(), key=self.key).digest(), "big")

    def feistel(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """Unbalanced-radix Feistel network, walked until the value is below n."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            right, left = divmod(x, a)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if turn % 2:
                    right = (right + sign * self.noise(tweak, turn, left)) % b
                else:
                    left = (left + sign * self.noise(tweak, turn, right)) % a
            x = right * a + left
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A shift seen through the network: one to one, and nothing stays in place."""
        if n < 2:
            return x
        tweak = f"{tweak}|{n}"
        shift = 1 + self.noise(tweak, ROUNDS, 0) % (n - 1)
        return self.feistel((self.feistel(x, n, tweak) + shift) % n, n, tweak, back=True)

    def text(self, value: str, tweak: str) -> str:
        """Letters and digits permuted inside their own alphabets, other characters kept."""
        slots = [(i, *PLACE[c]) for i, c in enumerate(value) if c in PLACE]
        x, n = 0, 1
        for _, alphabet, at in slots:
            x, n = x * len(alphabet) + at, n * len(alphabet)
        shape = "".join(str(ALPHABETS.index(PLACE[c][0])) if c in PLACE else c for c in value)
        y, out = self.permute(x, n, f"{tweak}|{shape}"), list(value)
        for i, alphabet, _ in reversed(slots):
            y, at = divmod(y, len(alphabet))
            out[i] = alphabet[at]
        return "".join(out)

    def digits(self, value: str, new: str) -> str:
        """The value's layout with new digits."""
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in value)

    def day(self, y: int, m: int, d: int) -> date | None:
        try:
            x = date(y, m, d).toordinal()
        except ValueError:
            return None
        return date.fromordinal(FIRST_DAY + self.permute(x - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")) if FIRST_DAY <= x <= LAST_DAY else None

    def _replace(self, kind: str, value: str) -> tuple[str, str] | None:
        """(kind, pseudonym), or None if the value is not valid."""
        plain = re.sub(r"[^0-9]", "", value)
        if kind == "email":
            local, _, domain = value.rpartition("@")
            low = local.lower()  # one mailbox, however it is written
            new = self.text(low if len(low) == len(local) else local, "email|" + domain.lower())
            return "email", "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(local, new)) + "@" + domain
        if kind == "iban":
            bare = value.replace(" ", "")
            if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
                return None
            body = self.text(bare[4:], f"iban|{bare[:2]}")
            it = iter(f"{bare[:2]}{98 - mod97(f'{bare[:2]}00{body}'):02d}{body}")
            return "iban", "".join(c if c == " " else next(it) for c in value)
        if kind == "ip":
            try:
                return "ip", str(IPv4Address(self.permute(int(IPv4Address(value)), 1 << 32, "ip4")))
            except AddressValueError:
                return None
        if kind == "ip6":
            try:
                return "ip", str(IPv6Address(self.permute(int(IPv6Address(value)), 1 << 128, "ip6")))
            except AddressValueError:
                return None
        if kind in ("ymd", "dmy"):
            a, sep, b, _, c = re.split(r"([-/.])", value)
            day_first = kind == "dmy" and (int(a) > 12 or sep == ".")
            new = self.day(int(a), int(b), int(c)) if kind == "ymd" else self.day(int(c), int(b if day_first else a), int(a if day_first else b))
            if new is None:
                return None
            wide = any(len(p) == 2 and p[0] == "0" for p in (a, b, c)) or all(len(p) != 1 for p in (a, b, c))
            two = lambda v: f"{v:02d}" if wide else str(v)
            parts = (f"{new.year:04d}", two(new.month), two(new.day))
            parts = parts if kind == "ymd" else (parts[2], parts[1], parts[0]) if day_first else (parts[1], parts[2], parts[0])
            return "date", sep.join(parts)
        if kind == "named":
            word = re.search(MONTH, value)[0]
            names = next(m for m in MONTHS if word.lower() in m)
            day, year = re.findall(r"[0-9]+", value)
            new = self.day(int(year), names.index(word.lower()) + 1, int(day))
            if new is None:
                return None
            name = names[new.month - 1]
            name = name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name
            put = lambda m: name if m[0] == word else f"{new.year:04d}" if len(m[0]) == 4 else str(new.day)
            return "date", re.sub(f"[0-9]+|{word}", put, value)
        if kind == "ssn":
            area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
            if area in (0, 666) or area > 899 or not group or not serial:
                return None
            x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            rest, serial = divmod(self.permute(x, 898 * 99 * 9999, "ssn"), 9999)
            area, group = divmod(rest, 99)
            return "ssn", f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "card":
            if luhn(plain):
                return None
            n = len(plain) - 2
            new = f"{plain[0]}{self.permute(int(plain[1:-1]), 10**n, f'card|{plain[0]}'):0{n}d}"
            return "card", self.digits(value, f"{new}{-luhn(new + '0') % 10}")
        if not 7 <= len(plain) <= 15:
            return None
        # the country's code, found from the digits alone: spellings of a number stay linked
        code = next((plain[:n] for n in (1, 2) if plain[:n] in CODES), plain[:3]) if value[0] == "+" else ""
        n = len(plain) - len(code)
        return "phone", self.digits(value, f"{code}{self.permute(int(plain[len(code) :]), 10**n, f'phone|{code}'):0{n}d}")

    def shorter(self, kind: str, value: str) -> tuple[str, tuple[str, str] | None]:
        """The longest valid beginning of an invalid card or account number that ends before
        a separator, as other numbers or words may stand next to one."""
        cuts = [m.start() for m in re.finditer("[ -]", value)] if kind in ("card", "iban") else []
        for cut in reversed(cuts):
            part = value[:cut]
            if (kind == "iban" or sum(map(str.isdigit, part)) >= 13) and (new := self.replace(kind, part)):
                return part, new
        return value, None

    def scan(self, text: str | None) -> tuple[str | None, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        found: Counter = Counter()
        if not text or not HINT.search(text):
            return text, found
        at, out = 0, []
        while m := PATTERN.search(text, at):
            kind, value = m.lastgroup if m.lastgroup not in ("s1", "s2") else ("ymd" if m["ymd"] else "dmy"), m[0]
            new = self.replace(kind, value)
            if new is None:
                value, new = self.shorter(kind, value)
            if new is None:  # its tail may still be something valid
                step = TOKEN.match(text, m.start()).end()
                out.append(text[at:step])
                at = step
                continue
            found[new[0]] += 1
            out.append(text[at : m.start()])
            out.append(new[1])
            at = m.start() + len(value)
        out.append(text[at:])
        return "".join(out), found


def pseudonymised(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """All columns with the text pseudonymised, then pii: one count for each of KINDS."""
    maker: list[Pseudonyms] = []  # one in each worker

    def run(texts: list) -> dict:
        if not maker:
            maker.append(Pseudonyms(key))
        done = [maker[0].scan(t) for t in texts]
        return {"pseudonymised": pa.array([t for t, _ in done], pa.string()), "pii": pa.array([[n.get(k, 0) for k in KINDS] for _, n in done], pa.list_(pa.int32()))}

    names, place = docs.columns, docs.columns.index(text_col)
    inner = add_columns(docs, text_col, run, "pseudonymised string, pii array<int>").toDF(*(f"c{i}" for i in range(len(names))), "new", "pii")
    return inner.select(*("new" if i == place else f"c{i}" for i in range(len(names))), "pii").toDF(*names, "pii")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, and a count for each kind."""
    done = pseudonymised(docs.select("doc_id", "text"))
    counts = [F.col("pii")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return done.select("doc_id", "text", F.aggregate("pii", F.lit(0), lambda a, x: a + x).alias("n_replaced"), *counts)
