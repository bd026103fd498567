"""Format-preserving pseudonyms for personal data.

Validated values are replaced by others of the same format: a keyed Feistel
network permutes the numbers a format can express, so equal values get equal
pseudonyms in every document and different values different ones, without a
table of what was seen. Separators and letter case stay as they are.

Recognised, each only if its validation holds:

* card numbers: 13 to 19 digits, also in groups, with a valid check digit, which
  the pseudonym has as well; other numbers stay as they are;
* IPv4 addresses with four parts up to 255;
* telephone numbers with a country code or an area code in brackets;
* social security numbers ``ddd-dd-dddd`` in the ranges that are issued;
* bank account numbers (IBAN) with valid check digits;
* dates between 1900 and 2099 that exist: ``yyyy-mm-dd``, ``yyyy/mm/dd``,
  ``dd.mm.yyyy``, ``dd/mm/yyyy``;
* e-mail addresses: the local part and the domain but for its last label;
* secrets: 32 to 128 hexadecimal digits in a row.

A card number or IBAN may be followed by groups that look like a part of it. Where
the longest match is not valid, its shorter runs of whole groups are tried, and the
longest valid one is taken (an IBAN's only at the length its country has, if known).

Defined cases: NULL text stays NULL, an empty text empty; a document's pseudonyms
do not depend on its id, its other columns or its neighbours, so repeated rows
stay equal; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches

#: For tests and reproducible runs; production passes its own secret.
KEY = b"not a secret: pass your own key"
ROUNDS = 8

FOUND = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}(?![\w-]))
  | (?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
  | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9]))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<date>(?<![\w./-])(?:\d{4}([-/])\d{2}\7\d{2}|\d{2}([./])\d{2}\8\d{4})(?![\w/-]|\.\d))
  | (?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w))
""", re.VERBOSE)
KINDS = ("email", "ip", "iban", "secret", "ssn", "date", "card", "phone")
#: What every match holds; texts without it are not searched.
ANY = re.compile(r"\d|@|[0-9a-fA-F]{32}")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20}
LEAST_CARD, LEAST_IBAN = 13, 12
DAYS = (date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal())


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of ``range(size)``: a Feistel network over two halves, walked until it is back in range."""
    if size < 2:
        return value
    right = isqrt(size - 1) + 1
    left = -(-size // right)
    seed = tweak.encode() + size.to_bytes(size.bit_length() // 8 + 1, "big")
    while True:
        a, b = divmod(value, right)
        for i in range(ROUNDS):
            if i % 2 == 0:
                a = (a + _mix(b, i, key, seed)) % left
            else:
                b = (b + _mix(a, i, key, seed)) % right
        value = a * right + b
        if value < size:
            return value


def _mix(half: int, i: int, key: bytes, seed: bytes) -> int:
    data = bytes([i]) + half.to_bytes(half.bit_length() // 8 + 1, "big") + b"|" + seed
    return int.from_bytes(blake2b(data, digest_size=64, key=key).digest(), "big")


def _characters(text: str, key: bytes, tweak: str) -> str:
    """Permutes letters among letters and digits among digits; case and everything else stays."""
    radix = [10 if c in "0123456789" else 26 if "a" <= c.lower() <= "z" else 1 for c in text]
    value = size = 0
    size = 1
    for c, r in zip(text.lower(), radix, strict=True):
        if r > 1:
            value = value * r + (ord(c) - 48 if r == 10 else ord(c) - 97)
            size *= r
    value, out = permute(value, size, key, tweak), []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r == 1:
            out.append(c)
            continue
        value, d = divmod(value, r)
        new = chr(48 + d) if r == 10 else chr(97 + d)
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> int:
    """Check digit of the digits before it."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    body = digits[:-1]
    if luhn(body) != int(digits[-1]):
        return None
    new = str(permute(int(body), 10 ** len(body), key, f"card{len(body)}")).zfill(len(body))
    return _fill(text, new + str(luhn(new)))


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if len(plain) > 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = _characters(plain[4:], key, "iban" + plain[:2])
    new = plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _secret(text: str, key: bytes) -> str:
    value = permute(int(text, 16), 1 << 4 * len(text), key, "secret")
    new = f"{value:0{len(text)}x}"
    return new.upper() if text.isupper() else new


def _ssn(text: str, key: bytes) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = _digits(text)
    if not valid(digits):
        return None
    while True:  # walks the permutation's cycle until it is back among the valid ones
        digits = str(permute(int(digits), 10 ** 9, key, "ssn")).zfill(9)
        if valid(digits):
            return _fill(text, digits)


def _date(text: str, key: bytes) -> str | None:
    first = text[2].isdigit()
    year, month, day = (text[:4], text[5:7], text[8:]) if first else (text[6:], text[3:5], text[:2])
    try:
        at = date(int(year), int(month), int(day)).toordinal() - DAYS[0]
    except ValueError:
        return None
    if not 0 <= at < DAYS[1] - DAYS[0]:
        return None
    new = date.fromordinal(DAYS[0] + permute(at, DAYS[1] - DAYS[0], key, "date"))
    return _fill(text, f"{new:%Y%m%d}" if first else f"{new:%d%m%Y}")


def _phone(text: str, key: bytes) -> str | None:
    at = re.match(r"\+\d{1,3}(?=[ .(-])|", text).end()  # the country code stays
    digits = _digits(text[at:])
    if not 7 <= len(digits) <= 15:
        return None
    return text[:at] + _fill(text[at:], str(permute(int(digits), 10 ** len(digits), key, f"phone{len(digits)}")).zfill(len(digits)))


def _email(text: str, key: bytes) -> str:
    at = text.rindex(".")
    return _characters(text[:at], key, f"email{len(text)}") + text[at:]


REPLACE: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "ip": _ip, "iban": _iban, "secret": _secret, "ssn": _ssn, "date": _date, "card": _card, "phone": _phone}


def _shorter_cards(text: str) -> list[tuple[int, int]]:
    """Runs of whole groups with enough digits, longest first; not all of ``text``."""
    groups = [m.span() for m in re.finditer(r"\d+", text)]
    runs = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if (a, b) != (0, len(text)) and len(_digits(text[a:b])) >= LEAST_CARD]
    return sorted(runs, key=lambda r: (-len(_digits(text[r[0]:r[1]])), r))


def _shorter_ibans(text: str) -> list[tuple[int, int]]:
    """Beginnings of whole groups, longest first; where the country's length is known, the one of that length."""
    ends = [m.start() for m in re.finditer(" ", text)][::-1]
    sizes = {e: len(text[:e].replace(" ", "")) for e in ends}
    known = IBAN_LENGTHS.get(text[:2])
    return [(0, e) for e in ends if (sizes[e] == known if known else sizes[e] >= LEAST_IBAN)]


SHORTER: dict[str, Callable[[str], list[tuple[int, int]]]] = {"card": _shorter_cards, "iban": _shorter_ibans}


def replacer(key: bytes) -> Callable[[str], tuple[str, list[tuple[str, int, int]]]]:
    """Gives a text's pseudonymised form and the (kind, start, end) spans replaced, counted in characters of the original."""
    @lru_cache(1 << 16)
    def pseudonym(kind: str, text: str) -> str | None:
        return REPLACE[kind](text, key)

    def replace(text: str) -> tuple[str, list[tuple[str, int, int]]]:
        if not ANY.search(text):
            return text, []
        out, spans, at, look = [], [], 0, 0
        while match := FOUND.search(text, look):
            kind, (start, end) = match.lastgroup or "", match.span()
            kind = next(k for k in KINDS if match.start(k) >= 0)
            new = pseudonym(kind, match.group())
            if new is None and kind in SHORTER:
                for a, b in SHORTER[kind](match.group()):
                    if (new := pseudonym(kind, match.group()[a:b])) is not None:
                        start, end = start + a, start + b
                        break
            if new is None:  # not valid as this kind; what begins later may still be one
                look = _skip(text, start, end)
                continue
            out += [text[at:start], new]
            spans.append((kind, start, end))
            at = look = end
        return "".join([*out, text[at:]]), spans
    return replace


def _skip(text: str, start: int, end: int) -> int:
    """Where to go on after an invalid match: behind its first run of digits or letters."""
    while start < end and text[start].isalnum():
        start += 1
    return max(start, start + 1 if start < end else start)


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms, ``spans`` (kind, start, end in the original) of every row."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        replace = replacer(key)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(None, []) if t is None else replace(t) for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array(spans, spans_type)],
                                              ["doc_id", "text", "spans"])
        return one
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, text string, spans array<struct<kind: string, start: int, end: int>>", make)


def replaced(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``n_chars`` following it; all other columns as they are."""
    names = docs.columns
    at = names.index("text")

    def make():
        replace = replacer(key)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([None if t is None else replace(t)[0] for t in batch.column(at).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names)
        return one
    new = docs.mapInArrow(_batches(make), docs.schema)
    return new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in names else new


def _batches(make):
    def run(batches):
        one = make()
        for batch in batches:
            yield one(batch)
    return run
