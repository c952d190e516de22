"""PII: format-preserving Feistel pseudonyms (operator 9).

Validated values are found in whole texts and permuted, under a key, within their own format:

* payment cards: 13 to 19 digits, also as 4-4-4-4 or 4-6-5 with spaces or hyphens, with a right Luhn digit; the digits before it
  are permuted, the Luhn digit is made anew;
* IBANs with right check digits: letters stay letters, digits digits, the check digits are made anew;
* social security numbers (3-2-4) with an assignable area, group and serial;
* North American phone numbers (3-3-4, the area in parentheses or not, with or without +1);
* IPv4 addresses;
* dates (year-month-day, and day and month in either order with a four-digit year, joined by
  ``-``, ``/`` or ``.``) that are in the calendar between 1900 and 2099, as days of that span;
* the local part of e-mail addresses, character class by character class.

Each value is a number in the set of all values of its kind and shape.  A Feistel network over
two unequal halves, with keyed BLAKE2 rounds, permutes a slightly larger range; walking its cycle
until the value is valid again makes it a permutation of the valid values.  So equal values have
equal pseudonyms in every document, different ones different, and the key holder can go back
(``restore``).  Where a date can be read in both orders, day first is assumed.

A candidate that fails its check hides nothing: from the same place shorter ends (an IBAN by the
length of its country first) and the other kinds are tried, then the search goes on at the next
token, so that a valid value next to upper-case words or groups of digits is found.

It is one pass over the texts, no shuffle, nothing gathered.

Defined cases: a null text stays null and has no values; numbers that fail their check stay as
they are; ids only label rows, repeated rows each get a row; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt, prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from solera.llm.common import text_batches

#: For tests and the registered query; pass a secret key of your own.
KEY = b"example key, not a secret"
ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
_DAY0, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days

_FIND = re.compile(r"""
  (?P<email>[A-Za-z0-9._%+-]{1,64}(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))
| (?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])
| (?<![0-9.\-/])(?P<date>(?:(?:19|20)[0-9]{2}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)(?:19|20)[0-9]{2}))(?![0-9\-/]|\.[0-9])
| (?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])
| (?<![0-9\-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9\-])
| (?<![0-9])(?P<phone>(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4})(?![0-9])
| (?<![0-9])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<s3>[ \-])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{4}|[0-9]{4}(?P<s4>[ \-])[0-9]{6}(?P=s4)[0-9]{5})(?![0-9])
""", re.X)
_MAYBE = re.compile("[0-9@]")
#: Each kind alone, to be tried at the start of a candidate that failed.
_ALONE = {m.group(1): re.compile(f"(?:{part})", re.X) for part in re.split(r"\n\|", _FIND.pattern) if (m := re.search(r"\(\?P<(\w+)>", part))}
_TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Characters of an IBAN by country; of other countries every end of a word is tried, longest first.
_IBAN_LENGTH = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27"
    " GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27"
    " MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23"
    " TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())


class Feistel:
    """A keyed permutation of range(n); ``back`` runs it in reverse."""

    def __init__(self, key: bytes, tweak: str, n: int, back: bool = False):
        self.key, self.tweak, self.n, self.back = hashlib.blake2b(key).digest(), tweak.encode(), n, back
        self.b = isqrt(max(0, n - 1)) + 1
        self.a = -(-n // self.b)

    def _round(self, k: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%s|%d|%d" % (self.tweak, k, x), key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            sign = -1 if self.back else 1
            if k % 2:
                right = (right + sign * self._round(k, left)) % self.b
            else:
                left = (left + sign * self._round(k, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            x = self._once(x)
            if x < self.n and valid(x):
                return x


def _luhn(digits: str) -> int:
    """The digit that follows ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, new: str) -> str:
    """``new`` characters in the places of the letters and digits of ``shape``."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _classes(text: str) -> list[str]:
    return ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz" for c in text]


def _permuted(text: str, make: Callable[[str, int], Feistel], kind: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    """ASCII letters and digits permuted within their classes."""
    sets = _classes(text)
    n, x = prod(map(len, sets)), 0

    def spelled(x: int) -> str:
        out = []
        for s in reversed(sets):
            x, k = divmod(x, len(s))
            out.append(s[k])
        return "".join(reversed(out))

    for s, c in zip(sets, text):
        x = x * len(s) + s.index(c)
    shape = "".join(s[0] for s in sets)
    return spelled(make(f"{kind}:{shape}", n)(x, lambda y: valid(spelled(y))))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _date(text: str) -> tuple[dt.date, str] | None:
    """The day and the order of its fields."""
    sep = next(c for c in text if not c.isdigit())
    f = [int(x) for x in text.split(sep)]
    orders = ("ymd",) if len(text.split(sep)[0]) == 4 else ("dmy", "mdy")
    for o in orders:
        v = dict(zip(o, f))
        try:
            return dt.date(v["y"], v["m"], v["d"]), o
        except ValueError:
            continue
    return None


def _spell_date(day: dt.date, order: str, like: str) -> str | None:
    """``day`` in the fields and separators of ``like``; None if it would be read otherwise."""
    sep = next(c for c in like if not c.isdigit())
    padded = any(len(x) == 2 and x[0] == "0" for x in like.split(sep)) or all(len(x) != 1 for x in like.split(sep))
    out = sep.join(f"{day.year:04d}" if c == "y" else f"{day.month if c == 'm' else day.day:0{2 if padded else 1}d}" for c in order)
    read = _date(out)
    again = any(len(x) == 2 and x[0] == "0" for x in out.split(sep)) or all(len(x) != 1 for x in out.split(sep))
    return out if read == (day, order) and again == padded else None


def pseudonym(kind: str, text: str, make: Callable[[str, int], Feistel]) -> str | None:
    """The pseudonym of a found value; None if it is not valid."""
    bare = "".join(c for c in text if c.isalnum())
    if kind == "card":
        if not 13 <= len(bare) <= 19 or int(bare[-1]) != _luhn(bare[:-1]) or len(set(bare)) == 1:
            return None
        new = _permuted(bare[:-1], make, kind, lambda d: len(set(d + str(_luhn(d)))) > 1)
        return _refill(text, new + str(_luhn(new)))
    if kind == "iban":
        if not 15 <= len(bare) <= 34 or _iban_check(bare[:2], bare[4:]) != bare[2:4]:
            return None
        new = _permuted(bare[4:], make, f"iban-{bare[:2]}")
        return _refill(text, bare[:2] + _iban_check(bare[:2], new) + new)
    if kind == "ssn":
        return _refill(text, _permuted(bare, make, kind, _ssn_ok)) if _ssn_ok(bare) else None
    if kind == "phone":
        head, local = bare[:-10], bare[-10:]
        return _refill(text, head + _permuted(local, make, kind))
    if kind == "ip":
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        return ".".join(map(str, make("ip", 1 << 32)(int.from_bytes(bytes(parts), "big")).to_bytes(4, "big")))
    if kind == "date":
        found = _date(text)
        if not found or not 0 <= (found[0] - _DAY0).days < _DAYS:
            return None
        day, order = found
        spelled = lambda x: _spell_date(_DAY0 + dt.timedelta(days=x), order, text)
        if spelled((day - _DAY0).days) is None:  # day and month written unalike, such as 1/02/2003
            return None
        sep = next(c for c in text if not c.isdigit())
        return spelled(make("date", _DAYS)((day - _DAY0).days, lambda x: spelled(x) is not None)) if sep else None
    return _refill(text, _permuted(bare, make, kind)) if bare and bare.isascii() else None


def _readings(m: re.Match, text: str) -> Iterator[tuple[str, str]]:
    """(kind, value): the candidate, then what else may start where it starts."""
    first = next(k for k in KINDS if m.group(k) is not None)
    for kind in (first, *(k for k in KINDS if k != first)):
        alone = m if kind == first else _ALONE[kind].match(text, m.start())
        if alone is None:
            continue
        found = alone.group(kind)
        if kind == "iban":
            ends = {k: found[:g.end()] for k, g in enumerate(re.finditer("[A-Za-z0-9]", found), 1) if not found[g.end():g.end() + 1].isalnum()}
            n = _IBAN_LENGTH.get(found[:2])
            if n and int(n) in ends:
                yield kind, ends[int(n)]
            yield kind, found
            if n is None:
                yield from ((kind, e) for k, e in reversed(ends.items()) if k >= 15 and e != found)
        else:
            yield kind, found


def replacer(key: bytes = KEY, back: bool = False) -> Callable[[str], tuple[str, dict[str, int]]]:
    """A function from a text to its pseudonymised text and the number of values of each kind."""
    @lru_cache(1 << 14)
    def new(kind: str, text: str) -> str | None:
        return pseudonym(kind, text, lambda tweak, n: Feistel(key, tweak, n, back))

    def replace(text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        if not _MAYBE.search(text):
            return text, counts

        out, done, at = [], 0, 0
        while m := _FIND.search(text, at):
            for kind, found in _readings(m, text):
                value = new(kind, found)
                if value is not None:
                    counts[kind] += 1
                    out += [text[done:m.start()], value]
                    done = at = m.start() + len(found)
                    break
            else:
                token = _TOKEN.search(text, m.start(), m.end())
                at = token.end() if token else m.end()
        return "".join([*out, text[done:]]), counts

    return replace


def restore(text: str, key: bytes) -> str:
    """The text before ``replacer(key)``, unless a pseudonym and its neighbours pass a check by chance."""
    return replacer(key, back=True)(text)[0]


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column ``n_<kind>`` for each kind, in the place of
    any column of that name."""
    text_batches(docs.sparkSession)
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replace = replacer(key)
        for pdf in batches:
            done = [replace(t) if isinstance(t, str) else (None, dict.fromkeys(KINDS, 0)) for t in pdf["text"]]
            yield pdf.assign(text=[t for t, _ in done], **{f"n_{k}": [c[k] for _, c in done] for k in KINDS})

    return docs.mapInPandas(run, schema)
