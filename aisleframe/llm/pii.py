"""Format-preserving pseudonyms for personal data.

Values are found by their format and validated: card numbers by their check
digit, account numbers (IBAN) by theirs, dates by the calendar, addresses by
their ranges. A valid value is a number within the set of values of its format,
and a keyed Feistel network permutes that set: equal values get equal
pseudonyms in all documents, different values different ones, and with the key
the value comes back. Check digits are computed anew, so a pseudonym is valid.
Anything that does not validate is left as it is.

Telephone numbers are taken in any grouping: international ones with 8 to 15
digits, national ones of ten digits or with a leading zero. Dates with slashes
are read month first, and day first where that is no date; either kind is
permuted within itself, so what comes back is what was there. Addresses of the
long kind (IPv6) keep their groups; one in mixed case is left as it is.

Nulls: a null text stays null with zero counts and an empty one stays empty; a
null id is carried; repeated rows get equal results; an empty table gives an
empty one. Whole texts are searched, in memory in proportion to the longest.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: First and last day of the dates that are permuted among each other.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(n): balanced Feistel on the next even number of
    bits, walked until the result falls into the range."""
    if n < 2:
        return x
    half = max((n - 1).bit_length() + 1, 2) // 2
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            known = left if back else right
            data = f"{tweak}|{n}|{r}|".encode() + known.to_bytes(size, "big")
            f = int.from_bytes(hashlib.blake2b(data, key=key, digest_size=min(64, size + 8)).digest(), "big") & mask
            if back:
                left, right = right ^ f, left
            else:
                left, right = right, left ^ f
        x = left << half | right
        if x < n:
            return x


def permute_text(s: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Letters and digits permuted jointly, each staying in its class; marks stay."""
    kinds = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in s]
    n = x = 0
    for c, a in zip(s, kinds):
        if a:
            n, x = (n or 1) * len(a), x * len(a) + a.index(c)
    shape = "".join("dlu"[(DIGITS, LOWER, UPPER).index(a)] if a else c for c, a in zip(s, kinds))
    x = permute(x, n, key, f"{tweak}|{shape}", back) if n else 0
    out = list(s)
    for i in reversed(range(len(s))):
        if kinds[i]:
            x, d = divmod(x, len(kinds[i]))
            out[i] = kinds[i][d]
    return "".join(out)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    fill = iter(digits)
    return "".join(next(fill) if c.isdigit() else c for c in pattern)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card", back)).zfill(len(d) - 1)
    return _refill(s, body + luhn_digit(body))


def _iban(s: str, key: bytes, back: bool) -> str | None:
    plain = s.replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    if rest(plain) != 1:
        return None
    body = permute_text(plain[4:], key, "iban" + plain[:2], back)
    # int(c, 36) makes no difference between cases, and every letter keeps its own.
    new = iter(plain[:2] + f"{98 - rest(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in s.split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 2**32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(s: str, key: bytes, back: bool) -> str | None:
    """The hexadecimal digits permuted in place; an address with letters keeps having some, in their case."""
    digits = s.replace(":", "")
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    if not digits or (digits != digits.lower() and digits != digits.upper()):
        return None
    lettered = not digits.isdigit()
    x, n = int(digits, 16), 16 ** len(digits)
    while True:
        x = permute(x, n, key, "ip6" + re.sub("[^:]", "x", s), back)
        new = f"{x:0{len(digits)}x}"
        if new.isdigit() != lettered:
            break
    fill = iter(new.upper() if lettered and digits == digits.upper() else new)
    return "".join(c if c == ":" else next(fill) for c in s)


def _phone(s: str, key: bytes, back: bool) -> str | None:
    # The country code, or a leading zero, stays; all other digits are permuted together.
    head = re.match(r"\+\d{1,3}(?=[ .(/-])|\(?0(?=\d)", s)
    cut = head.end() if head else 0
    d = re.sub(r"\D", "", s[cut:])
    x, n = int(d), 10 ** len(d)
    while True:
        x = permute(x, n, key, f"phone{s[:cut]}", back)
        # Without a code in front, a leading zero would be read as one.
        if cut or s[0] == "+" or x >= n // 10:
            return s[:cut] + _refill(s[cut:], str(x).zfill(len(d)))


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    a, b, c = (int(p) for p in s.split("-"))
    if a in (0, 666) or a > 899 or not b or not c:
        return None
    x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    x, c = divmod(permute(x, 898 * 99 * 9999, key, "ssn", back), 9999)
    a, b = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def _date(order: str, mark: str) -> Callable[[str, bytes, bool], str | None]:
    def run(s: str, key: bytes, back: bool) -> str | None:
        part = dict(zip(order, s.split(mark)))
        y, m, d = (int(part[k]) for k in "ymd")
        if not (FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
            return None
        days = (LAST_DAY - FIRST_DAY).days + 1
        new = FIRST_DAY + dt.timedelta(permute((dt.date(y, m, d) - FIRST_DAY).days, days, key, "date", back))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return mark.join(values[k] for k in order)

    return run


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """The days after the twelfth of a month, as numbers from FIRST_DAY: day first, they cannot be read month first."""
    return [k for k in range((LAST_DAY - FIRST_DAY).days + 1) if (FIRST_DAY + dt.timedelta(k)).day > 12]


def _slash_date(s: str, key: bytes, back: bool) -> str | None:
    first = _date("mdy", "/")(s, key, back)
    if first is not None:
        return first
    d, m, y = (int(p) for p in s.split("/"))
    if not (FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12 and 12 < d <= calendar.monthrange(y, m)[1]):
        return None
    late = _late_days()
    at = bisect_left(late, (dt.date(y, m, d) - FIRST_DAY).days)
    new = FIRST_DAY + dt.timedelta(late[permute(at, len(late), key, "day first", back)])
    return f"{new.day:02d}/{new.month:02d}/{new.year:04d}"


def _email(s: str, key: bytes, back: bool) -> str | None:
    stem, dot, end = s.rpartition(".")
    return permute_text(stem, key, "email", back) + dot + end


def _secret(s: str, key: bytes, back: bool) -> str | None:
    if re.fullmatch(r"[0-9a-f]+", s):
        return f"{permute(int(s, 16), 16 ** len(s), key, f'hex{len(s)}', back):0{len(s)}x}"
    return permute_text(s, key, "secret", back)


#: (kind, pattern, pseudonym of the group ``v``), tried in this order at each place.
RULES: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"(?<![\w.+-])(?P<v>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", _email),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_/+-]{8,})", _secret),
    ("iban", r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b", _iban),
    ("iban", r"\b(?P<v>[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)\b", _iban),
    ("phone", r"(?<![\w.])(?P<v>\+\d(?:[ .()/-]{0,2}\d){7,14})(?!\d)", _phone),
    ("phone", r"(?<![\w.+-])(?P<v>(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])", _phone),
    ("ssn", r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])", _ssn),
    ("date", r"(?<![\w-])(?P<v>\d{4}-\d{2}-\d{2})(?![\d-])", _date("ymd", "-")),
    ("date", r"(?<![\w/])(?P<v>\d{2}/\d{2}/\d{4})(?![\d/])", _slash_date),
    ("date", r"(?<![\w.])(?P<v>\d{2}\.\d{2}\.\d{4})(?![\d])", _date("dmy", ".")),
    ("ip", r"(?<![\w.])(?P<v>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)", _ip),
    ("ip", r"(?<![\w:.])(?P<v>(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39})(?![\w:.])", _ip6),
    ("phone", r"(?<![\w.+/-])(?P<v>(?:\(0\d{1,4}\) ?|0\d{1,4}[ -])\d{2,4}(?:[ -]?\d{2,4}){1,3})(?![\w/-])", _phone),
    ("card", r"(?<![\w.-])(?P<v>\d(?:[ -]?\d){12,18})(?![\w]|-\d)", _card),
]
KINDS = ["email", "secret", "iban", "phone", "ssn", "date", "ip", "card"]
#: Every rule's value has a digit or follows "@" or an assignment.
MAYBE = re.compile(r"[0-9@=:]")
_ALL = re.compile("|".join(f"(?:{p.replace('?P<v>', f'?P<v{i}>')})" for i, (_, p, _) in enumerate(RULES)))
_EACH = [re.compile(p) for _, p, _ in RULES]


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, Counter]:
    """The text with its valid values permuted (or restored), and counts by kind."""
    out, at, found, place = [], 0, Counter(), 0
    if not MAYBE.search(text):
        return text, found
    while m := _ALL.search(text, place):
        first = int(m.lastgroup[1:])
        place = m.end()
        new = None
        # A place that one rule matches but does not validate may be another rule's.
        for i in range(first, len(RULES)):
            own = m if i == first else _EACH[i].match(text, m.start())
            if own:
                group = f"v{i}" if i == first else "v"
                new = RULES[i][2](own.group(group), key, back)
                if new is not None:
                    a, b = own.span(group)
                    out += [text[at:a], new]
                    at = place = b
                    found[RULES[i][0]] += 1
                    break
        if new is None:
            place = m.start(m.lastgroup) + 1
    return "".join([*out, text[at:]]), found


def protect(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(id, n_<kind> for every kind, text): texts with pseudonyms, or restored with ``back``."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key needs 16 to 64 bytes")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, Counter()) if t is None else pseudonymise(t, key, back) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS),
                    pa.array([t for t, _ in done], pa.string()),
                ],
                names=[id_col, *(f"n_{k}" for k in KINDS), "text"],
            )

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {columns}, text string")
