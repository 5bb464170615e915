"""Format-preserving pseudonyms for personal data.

Numbers are found by their format and kept only if they validate: check digits
(payment cards, IBANs), ranges (network addresses), area and group rules (social
security numbers), the calendar (dates). Each value is ranked within its format,
the rank is permuted by a keyed Feistel network over exactly that many values
(cycle walking stays inside), and the new rank is written back in the same
format. One key gives one permutation per kind, so equal values stay equal in
every document, no two values meet, and whoever has the key can go back. Dates
with a month or day of one digit are formats of their own and keep their length.

Defined results: null texts stay null; empty texts have no findings; overlapping
finds go to the earlier, then longer one; repeated rows are treated alike.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

from pyspark.sql import DataFrame, functions as F

from .batches import map_columns

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Permutation:
    """A keyed permutation of 0..size-1."""

    def __init__(self, key: bytes, label: str, size: int):
        self.size = size
        self.b = max(1, isqrt(max(size - 1, 0)) + 1)
        self.a = -(-size // self.b)
        self.key = hashlib.blake2b(label.encode() + b"/" + str(size).encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, x: int, modulus: int) -> int:
        data = i.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        width = (modulus.bit_length() + 7) // 8 + 8
        return int.from_bytes(hashlib.shake_128(self.key + data).digest(width), "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)  # left < a, right < b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(i, left, self.b)) % self.b
            else:
                left = (left + sign * self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        while True:
            x = self._once(x, back)
            if x < self.size:
                return x


def luhn_digit(body: str) -> str:
    """The digit that makes ``body`` and it pass the mod-10 check."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _radix(text: str) -> tuple[int, int, list[tuple[int, str]]]:
    """Rank, number of values and shape of a string whose ASCII letters and digits may vary, case aside."""
    rank, size, shape = 0, 1, []
    for c in text:
        low = c.lower()
        n, v = (10, ord(c) - 48) if "0" <= c <= "9" else (26, ord(low) - 97) if c.isascii() and "a" <= low <= "z" else (1, 0)
        rank, size = rank * n + v, size * n
        shape.append((n, c))
    return rank, size, shape


def _spell(rank: int, shape: list[tuple[int, str]]) -> str:
    out = []
    for n, c in reversed(shape):
        rank, v = divmod(rank, n)
        out.append(c if n == 1 else chr(48 + v) if n == 10 else chr((65 if c.isupper() else 97) + v))
    return "".join(reversed(out))


@lru_cache(maxsize=4)
def _days(short_month: bool, short_day: bool) -> list[int]:
    """Ordinals of the days that a format can write: a month or day of one digit lies under 10."""
    every = range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1)
    if not short_month and not short_day:
        return list(every)
    each = ((n, datetime.date.fromordinal(n)) for n in every)
    return [n for n, d in each if not (short_month and d.month > 9) and not (short_day and d.day > 9)]


class Pseudonyms:
    """Finders and permuted rewritings by kind of personal data."""

    def __init__(self, key: bytes):
        self.key = key
        self._perm = lru_cache(maxsize=4096)(lambda label, size: Permutation(key, label, size))

    def _number(self, label: str, digits: str, back: bool) -> str:
        return str(self._perm(label, 10 ** len(digits))(int(digits), back)).zfill(len(digits))

    def card(self, text: str, back: bool = False) -> str | None:
        d = _digits(text)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = d
        while True:  # a card of one repeated digit is no card: walk on
            body = self._number("card", body[:-1], back)
            body += luhn_digit(body)
            if len(set(body)) > 1:
                return _refill(text, body)

    def iban(self, text: str, back: bool = False) -> str | None:
        flat = text.replace(" ", "").upper()
        check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
        if not 15 <= len(flat) <= 34 or check(flat) != 1:
            return None
        rank, size, shape = _radix(flat[4:])
        body = _spell(self._perm("iban" + flat[:2], size)(rank, back), shape)
        new = flat[:2] + f"{98 - check(flat[:2] + '00' + body):02d}" + body
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in text)

    def phone(self, text: str, back: bool = False) -> str | None:
        d = _digits(text)
        if not 10 <= len(d) <= 15:
            return None
        lead = len(d) - 10
        return _refill(text, d[:lead] + self._number("phone", d[lead:], back))

    def ssn(self, text: str, back: bool = False) -> str | None:
        ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = _digits(text)
        if not ok(d):
            return None
        while True:
            d = self._number("ssn", d, back)
            if ok(d):
                return _refill(text, d)

    def address(self, text: str, back: bool = False) -> str | None:
        try:
            value = int(ipaddress.IPv4Address(text))
        except ValueError:
            return None
        return str(ipaddress.IPv4Address(self._perm("ipv4", 2**32)(value, back)))

    def email(self, text: str, back: bool = False) -> str | None:
        local, _, domain = text.rpartition("@")
        rank, size, shape = _radix(local)
        return _spell(self._perm("email", size)(rank, back), shape) + "@" + domain if size > 1 else None

    def date(self, text: str, back: bool = False) -> str | None:
        sep = next(c for c in text if not c.isdigit())
        parts = text.split(sep)
        order = {"-": (0, 1, 2), ".": (2, 1, 0), "/": (2, 0, 1)}[sep]
        if sep == "/" and len(parts[0]) == 4:
            order = (0, 1, 2)
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        short = tuple(len(parts[order[k]]) == 1 for k in (1, 2))
        days = _days(*short)
        rank = self._perm("date" + "m" * short[0] + "d" * short[1], len(days))(bisect_left(days, day.toordinal()), back)
        new = datetime.date.fromordinal(days[rank])
        values = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:0{2 - short[0]}d}", order[2]: f"{new.day:0{2 - short[1]}d}"}
        return sep.join(values[i] for i in range(3))


#: Kind, where it may stand, and the method that validates and permutes it.
KINDS: list[tuple[str, re.Pattern[str]]] = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("address", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("date", re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{2}/\d{2})(?![\w/-]|\.\d)")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w.+-])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.+-])\d{3}-\d{3}-\d{4}(?![\w-])")),
]
_ANY = re.compile(r"[@\d]")
#: Digits that may hold a card, and the heads of IBANs.
_RUN = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,}")
_HEAD = re.compile(r"(?<!\w)[A-Z]{2}\d{2}")
#: Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 "
    "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}


def _cards(text: str, at: int) -> Iterator[tuple[int, int]]:
    """Places from ``at`` on where a card may stand, by start, the longest first: 13 to 19 digits in whole groups."""
    for run in _RUN.finditer(text, at):
        digits = [i for i in range(run.start(), run.end()) if text[i] not in " -"]
        for k, a in enumerate(digits):
            if a > run.start() and text[a - 1] not in " -" or a == run.start() and a > 0 and re.match(r"[\w.+-]", text[a - 1]):
                continue
            for n in range(min(19, len(digits) - k), 12, -1):
                b = digits[k + n - 1] + 1
                if b < run.end() and text[b] in " -" or b == run.end() and not re.match(r"[\w-]", text[b:b + 1]):
                    yield a, b


def _ibans(text: str, at: int) -> Iterator[tuple[int, int]]:
    """Places from ``at`` on where an IBAN may stand: its country's length, what the pattern takes, other lengths of unknown countries."""
    pattern = dict(KINDS)["iban"]
    for head in _HEAD.finditer(text, at):
        ends, n, i = {}, 4, head.end()
        while n < 34 and i < len(text):
            i += text[i] == " " and n % 4 == 0
            if not re.match(r"[A-Z0-9]", text[i:i + 1]):
                break
            n, i = n + 1, i + 1
            if n >= 15 and not re.match(r"\w", text[i:i + 1]):
                ends[n] = i
        known = IBAN_LENGTHS.get(head[0][:2])
        m = pattern.match(text, head.start())
        tries = [ends.get(known), m and m.end(), *(sorted(ends.values(), reverse=True) if known is None else ())]
        yield from ((head.start(), b) for b in dict.fromkeys(tries) if b)


_PLACES: dict[str, Callable[[str, int], Iterator[tuple[int, int]]]] = {"card": _cards, "iban": _ibans}


def _inside(text: str, kind: str, rewrite: Callable[[str, bool], str | None], back: bool) -> list[tuple[int, int, str, str]]:
    """Finds of a kind whose values may stand beside other digits or capitals: the first place that validates, then on behind it.

    A pseudonym must be found at the same place again, so others are walked over; the value itself is on that cycle.
    """
    valid = lambda t: rewrite(t, False) is not None
    first = lambda t, at: next((s for s in _PLACES[kind](t, at) if valid(t[s[0]:s[1]])), None)
    out, at = [], 0
    while (span := first(text, at)) is not None:
        a, b = span
        low, high = max(at, a - 64), b + 64
        near, rest = text[low:a], text[b:high]
        new = rewrite(text[a:b], back)
        while new is not None and new != text[a:b] and first(near + new + rest, 0) != first(near + text[a:b] + rest, 0):
            new = rewrite(new, back)
        out.append((a, b, kind, new))
        at = b
    return out


def find(text: str | None, pseudonyms: Pseudonyms, back: bool = False) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, pseudonym)`` of the validated finds in a text, in order and without overlap."""
    if not text or not _ANY.search(text):
        return []
    found = []
    digit = re.search(r"\d", text) is not None
    for kind, pattern in sorted(KINDS, key=lambda k: k[0] == "card"):
        if "@" not in text if kind == "email" else not digit:
            continue
        rewrite: Callable[[str, bool], str | None] = getattr(pseudonyms, kind)
        if kind in _PLACES:
            clear = text
            if kind == "card":  # what is a value of another fixed format is no part of a card
                for a, b, other, _ in found:
                    clear = clear[:a] + "." * (b - a) + clear[b:] if other in ("iban", "address", "ssn", "date") else clear
            found += _inside(clear, kind, rewrite, back)
            continue
        for m in pattern.finditer(text):
            new = rewrite(m[0], back)
            if new is not None:
                found.append((m.start(), m.end(), kind, new))
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def rewrite(text: str | None, found: list[tuple[int, int, str, str]]) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


@lru_cache(maxsize=4)
def _of(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``doc_id, text, finds`` of every row: the rewritten text and what was rewritten, with places in the text as given."""

    def run(doc_id: list, text: list) -> dict:
        found = [find(t, _of(key), back) for t in text]
        return {"doc_id": doc_id, "text": [rewrite(t, f) for t, f in zip(text, found, strict=True)],
                "finds": [[dict(zip(("start", "end", "kind", "pseudonym"), f, strict=True)) for f in fs] for fs in found]}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"),
                       "doc_id long, text string, finds array<struct<start: int, end: int, kind: string, pseudonym: string>>", run)
