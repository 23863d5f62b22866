"""Personal data replaced by format-preserving Feistel pseudonyms.

Validated values (card numbers by Luhn, IBANs by their check digits, IP
addresses, dates of the calendar, phone and social security numbers by their
ranges, mail addresses, keys and passwords) are permuted within their format by
a keyed Feistel network with cycle walking. Equal values get equal pseudonyms
in all documents, different values of a format different ones, and invert()
gives them back to who has the key. Numbers that fail validation stay.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import fresh, on_one_machine, valid

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def secret(spark: SparkSession) -> bytes:
    """The key: EVSCREEN_PII_KEY of the driver's environment. Where it is unset, one machine uses a fixed key for tests, and a cluster refuses."""
    key = os.environ.get("EVSCREEN_PII_KEY") or ("evscreen test key" if on_one_machine(spark) else None)
    if key is None:
        raise RuntimeError("EVSCREEN_PII_KEY must hold the key")
    return key.encode()


class Feistel:
    """Keyed permutations of range(n), each independent by name."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, name: str, i: int, half: int, n: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{name}|{n}|{i}|{half}".encode(), hashlib.sha256), "big")

    def permute(self, name: str, value: int, n: int, back: bool = False) -> int:
        """The image of value, or where it comes from. Domains of one value have none but themselves."""
        if not 0 <= value < n:
            raise ValueError("value outside its domain")
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        while True:  # cycle walking: a * a exceeds n by less than 2 * a + 1
            left, right = divmod(value, a)
            if back:
                for i in reversed(range(ROUNDS)):
                    left, right = (right - self._round(name, i, left, n)) % a, left
            else:
                for i in range(ROUNDS):
                    left, right = right, (left + self._round(name, i, right, n)) % a
            value = left * a + right
            if value < n:
                return value

    def walk(self, name: str, value: int, n: int, valid: Callable[[int], bool], back: bool = False) -> int:
        """permute within the valid values of range(n); value must be valid."""
        while True:
            value = self.permute(name, value, n, back)
            if valid(value):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), form)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def card(f: Feistel, s: str, back: bool) -> str | None:
    d = _digits(s)
    if not (13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1):
        return None
    body = f"{f.permute(f'card{len(d)}', int(d[:-1]), 10 ** (len(d) - 1), back):0{len(d) - 1}d}"
    return _refill(s, body + next(c for c in "0123456789" if luhn(body + c)))


def iban(f: Feistel, s: str, back: bool) -> str | None:
    """Digits of the account are permuted; letters, country and layout stay, and check digits are computed anew."""
    flat = re.sub("[^0-9A-Z]", "", s)
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    d = _digits(flat[4:])
    if not d:
        return None
    body = _refill(flat[4:], f"{f.permute(f'iban{len(d)}', int(d), 10 ** len(d), back):0{len(d)}d}")
    new = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
    return re.sub("[0-9A-Z]", lambda _: next(new), s)


def ip(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    value = sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts))
    new = f.permute("ip", value, 1 << 32, back)
    return ".".join(str(new >> 8 * (3 - i) & 255) for i in range(4))


def phone(f: Feistel, s: str, back: bool) -> str | None:
    """Ten digits, with or without a leading 1, whose area and exchange begin with 2 to 9; other international numbers after a +."""
    d = _digits(s)
    if s.startswith("+") and not d.startswith("1"):
        if not 8 <= len(d) <= 15:
            return None
        return _refill(s, d[:2] + f"{f.permute(f'tel{len(d)}{d[:2]}', int(d[2:]), 10 ** (len(d) - 2), back):0{len(d) - 2}d}")
    lead, own = ("1", d[1:]) if len(d) == 11 and d[0] == "1" else ("", d)
    good = lambda x: f"{x:010d}"[0] in "23456789" and f"{x:010d}"[3] in "23456789"
    if len(own) != 10:
        return None
    if not good(int(own)):
        return _refill(s, lead + f"{f.walk('phone0', int(own), 10**10, lambda x: not good(x), back):010d}") if s.startswith("+1") else None
    return _refill(s, lead + f"{f.walk('phone', int(own), 10**10, good, back):010d}")


def ssn(f: Feistel, s: str, back: bool) -> str | None:
    good = lambda x: (a := x // 10**6) not in (0, 666) and a < 900 and x // 10**4 % 100 and x % 10**4
    value = int(_digits(s))
    if not good(value):
        return None
    return _refill(s, f"{f.walk('ssn', value, 10**9, good, back):09d}")


def date(f: Feistel, s: str, back: bool) -> str | None:
    """Year first, or last with the month first after a slash and the day first after a dot or hyphen; from 1900 to 2099."""
    mark = re.search("[-./]", s)[0]
    parts = s.split(mark)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if mark == "/" else (2, 1, 0)
    if parts.count("") or len(parts) != 3:
        return None
    year, month, day = (int(parts[i]) for i in order)
    if mark == "/" and len(parts[0]) != 4 and month > 12 >= day:
        order, month, day = (2, 1, 0), day, month
    try:
        n = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= n <= _LAST_DAY:
        return None
    long = all(len(p) >= 2 for p in parts)
    form, swapped = f"date{mark}{order}", mark == "/" and order == (2, 1, 0)
    good = lambda x: not swapped or dt.date.fromordinal(x + _FIRST_DAY).day > 12  # noqa: E731  else it would read as month first
    new = dt.date.fromordinal(f.walk(form, n - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, good, back) + _FIRST_DAY)
    text = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}" if long else str(new.month), order[2]: f"{new.day:02d}" if long else str(new.day)}
    return mark.join(text[i] for i in range(3))


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(f: Feistel, name: str, s: str, back: bool, classes: tuple[str, ...] = _CLASSES) -> str:
    """Each digit stays a digit and each letter a letter of its case; everything else stays."""
    value, n, kinds = 0, 1, []
    for c in s:
        kind = next((k for k in classes if c in k), None)
        kinds.append(kind)
        if kind:
            value, n = value * len(kind) + kind.index(c), n * len(kind)
    if n < 2:
        return s
    if n.bit_length() > 900:  # longer values in parts
        half = len(s) // 2
        return _by_class(f, name + "<", s[:half], back, classes) + _by_class(f, name + ">", s[half:], back, classes)
    shape = "".join("-" if k is None else str(classes.index(k)) for k in kinds)
    value = f.permute(name + shape, value, n, back)
    out = []
    for c, kind in zip(reversed(s), reversed(kinds)):
        if kind:
            value, at = divmod(value, len(kind))
            c = kind[at]
        out.append(c)
    return "".join(reversed(out))


def mail(f: Feistel, s: str, back: bool) -> str | None:
    own, _, domain = s.rpartition("@")
    return _by_class(f, "mail", own, back) + "@" + domain


def hexed(f: Feistel, s: str, back: bool) -> str | None:
    if not re.search("[0-9]", s) or not re.search("[a-fA-F]", s):
        return None
    digits = "0123456789abcdef" if s.islower() else "0123456789ABCDEF" if s.isupper() else None
    return _by_class(f, "hex", s, back, (digits,)) if digits else None


def access_key(f: Feistel, s: str, back: bool) -> str | None:
    return s[:4] + _by_class(f, "key", s[4:], back, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))


def password(f: Feistel, s: str, back: bool) -> str | None:
    at = re.search("[=:]\\s*", s).end()
    return s[:at] + _by_class(f, "password", s[at:], back)


#: Kinds by precedence: pattern and pseudonym; where a match isn't valid, the next kinds are tried at the same place.
KINDS: tuple[tuple[str, str, Callable[[Feistel, str, bool], str | None]], ...] = (
    ("mail", r"[A-Za-z0-9._%+\-]*[A-Za-z0-9]@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", mail),
    ("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    ("password", r"(?i:password|passwd|pwd|secret|api[_-]?key|token)[=:][ ]?[A-Za-z0-9_\-+/]{6,}", password),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])", hexed),
    ("card", r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ip),
    ("date", r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}([./\-])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[./\-][0-9])", date),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", ssn),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])", phone),
    ("abroad", r"(?<![0-9A-Za-z+])\+[2-9](?:[ .\-]?\(?[0-9]\)?){7,14}(?![0-9])", phone),
)
_ANY = re.compile("|".join(f"(?P<{name}>{re.sub(r'\\1', '(?P=mark)', p.replace('([./', '(?P<mark>[./'))})" for name, p, _ in KINDS))
_EACH = [(name, re.compile(p), make) for name, p, make in KINDS]


class Pseudonyms:
    """Pseudonyms of one key, remembered while a task runs."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back, self.known = Feistel(key), back, {}

    def _new(self, kind: str, make: Callable, s: str) -> str | None:
        at = kind, s
        if at not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[at] = make(self.feistel, s, self.back)
        return self.known[at]

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind it has got."""
        out, last, at, counts = [], 0, 0, {}
        while m := _ANY.search(text, at):
            at = m.start() + 1
            for kind, pattern, make in _EACH:
                own = pattern.match(text, m.start())
                if own and (new := self._new(kind, make, own[0])) is not None:
                    out += [text[last : m.start()], new]
                    last = at = own.end()
                    counts[kind] = counts.get(kind, 0) + 1
                    break
        return ("".join(out) + text[last:] if out else text), counts


def _pseudonymise(key: bytes, columns: int, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            texts = tx.as_array(batch.column(columns))
            hit = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]|(?i:passw|pwd|secret|token|api)"), False).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(hit)
            new, counts = [], np.zeros(batch.num_rows, np.int64)
            for i in rows:
                text, found = names.apply(texts[int(i)].as_py())
                new.append(text)
                counts[i] = sum(found.values())
            changed = pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type)) if len(rows) else texts
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], changed, pa.array(counts)], [f"c{i}" for i in range(columns + 2)])

    return run


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes | None = None, keep: list[str] | None = None, count_col: str = "pseudonyms", invert: bool = False) -> DataFrame:
    """The columns keep of docs (all if None), text_col with pseudonyms, and how many it has got.

    Null and empty texts stay and count 0; repeated rows change alike; long
    texts are searched whole; bytes that aren't UTF-8 become U+FFFD. If docs already has a column named count_col, an
    underscore is added to the new one's name. With invert and the same key,
    the texts come back. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], valid(F.col(text_col)).alias(text_col))
    count = fresh(rows, count_col)[0]
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)), T.StructField(f"c{len(keep) + 1}", T.LongType())])
    out = rows.toDF(*[f"c{i}" for i in range(len(keep) + 1)]).mapInArrow(_pseudonymise(key or secret(docs.sparkSession), len(keep), invert), schema).toDF(*keep, text_col, count)
    return out
