"""Operator 10: format-preserving pseudonyms for personal data.

Validated numbers, dates, addresses and secrets are permuted within their own format by a keyed Feistel network:
a card stays a card with a right check digit, a date a date. Equal values have equal pseudonyms in all documents, dates and
phone numbers also if they are written in other ways.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import read_table, released

ROUNDS = 8
KEY_SETTING = "spark.corvane.pseudonym.key"
TEST_KEY = b"replace this key outside tests"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def feistel(x: int, half: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the integers of ``2 * half`` bits."""
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    size = half // 8 + 1
    for k in range(ROUNDS):
        mixed = hashlib.blake2b(right.to_bytes(size, "big") + bytes([k]) + tweak, digest_size=min(64, size + 8), key=key).digest()
        left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
    return left << half | right


def permuted(x: int, size: int, key: bytes, tweak: bytes, accept: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the accepted integers below ``size``: the network is walked until it lands on one."""
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    y = feistel(x, half, key, tweak)
    while y >= size or not accept(y):
        y = feistel(y, half, key, tweak)
    return y


def by_radix(text: str, alphabets: list[str], key: bytes, tweak: bytes) -> str:
    """Permute a string whose k-th character is of the k-th alphabet."""
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(value, size, key, tweak + str(size).encode())
    out = []
    for a in reversed(alphabets):
        value, k = divmod(value, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def by_class(text: str, key: bytes, tweak: bytes, hexa: bool = False) -> str:
    """Permute letters and digits within their class (or all as hex digits) and leave other characters in place."""
    spots = [(i, HEX if hexa else next(a for a in (DIGITS, LOWER, UPPER) if c in a)) for i, c in enumerate(text) if c in DIGITS or c in LOWER or c in UPPER]
    new = by_radix("".join(text[i] for i, _ in spots), [a for _, a in spots], key, tweak)
    out = list(text)
    for (i, _), c in zip(spots, new):
        out[i] = c
    return "".join(out)


def with_digits(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that these digits need after them."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[:1] + by_radix(digits[1:-1], [DIGITS] * (len(digits) - 2), key, b"card" + digits[:1].encode())
    return with_digits(text, body + str(luhn(body)))


def ssn(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)

    def valid(n: int) -> bool:
        s = f"{n:09d}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    return with_digits(text, f"{permuted(int(digits), 10**9, key, b'ssn', valid):09d}") if valid(int(digits)) else None


def phone(text: str, key: bytes) -> str | None:
    """North American numbers stay such (no 0 or 1 before area and exchange); others keep their country code."""
    digits = re.sub(r"\D", "", text)
    if text.startswith("+") and not text.startswith("+1"):
        code = re.match(r"\+\d{1,3}(?=\D)|\+\d\d", text).group()
        rest = digits[len(code) - 1 :]
        if not 6 <= len(rest) <= 13:
            return None
        return code + with_digits(text[len(code) :], by_radix(rest, [DIGITS] * len(rest), key, b"phone" + code.encode()))
    own, lead = digits[-10:], digits[:-10]

    def dialled(n: int) -> bool:
        s = f"{n:010d}"
        return s[0] > "1" and s[3] > "1"

    kind = dialled(int(own))
    return with_digits(text, lead + f"{permuted(int(own), 10**10, key, b'phone', lambda n: dialled(n) == kind):010d}")


def address(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    a, sep, b, _, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)", text).groups()
    orders = [(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)]
    for k, (y, m, d) in enumerate(orders):
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date"))
            fields = [f"{new.year:04d}", f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}"]  # one digit: written without a leading zero
            return sep.join(fields if len(a) == 4 else [fields[2], fields[1], fields[0]] if k == 0 else [fields[1], fields[2], fields[0]])
    return None


def iban(text: str, key: bytes) -> str | None:
    own = text.replace(" ", "")

    def number(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s))

    if not 15 <= len(own) <= 34 or number(own[4:] + own[:4]) % 97 != 1:
        return None
    body = by_class(own[4:], key, b"iban" + own[:2].encode())
    new = own[:2] + f"{98 - number(body + own[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def email(text: str, key: bytes) -> str | None:
    """The local part and the first label of the host."""
    local, _, host = text.partition("@")
    first, dot, rest = host.partition(".")
    return by_class(f"{local}@{first}", key, b"email") + dot + rest


def credential(text: str, key: bytes) -> str | None:
    """Words of prose after the name of a credential are none: its value mixes letters and digits, or is long and mixed in case."""
    letters, digits = any(c in LOWER or c in UPPER for c in text), any(c in DIGITS for c in text)
    mixed = any(c in LOWER for c in text) and any(c in UPPER for c in text[1:])
    return secret(text, key) if letters and digits or digits and len(text) >= 12 or mixed and len(text) >= 12 else None


def secret(text: str, key: bytes) -> str | None:
    return by_class(text, key, b"secret", hexa=all(c in HEX for c in text))


# Formats by kind; a candidate becomes a pseudonym if its kind's check holds.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}", email),
    "access_key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<own_access_key>[A-Z0-9]{16})(?![A-Za-z0-9])", secret),
    "credential": (r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth)[\"']?\s{0,4}[=:]\s{0,4}[\"']?(?P<own_credential>[A-Za-z0-9_\-+/.=]{8,512})", credential),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "date": (r"(?<![\d.\-/])(?:\d{4}(?P<sep_a>[-/.])\d{1,2}(?P=sep_a)\d{1,2}|\d{1,2}(?P<sep_b>[-/.])\d{1,2}(?P=sep_b)\d{4})(?![\d\-/]|\.\d)", date),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    "ssn": (r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", ssn),
    "plain_phone": (r"(?i:\b(?:tele)?phone|\btel|\bmobile|\bcell|\bfax|\bcall)(?i:[ .:#]{1,3}|(?: number)?(?: is|:)? ?)(?P<own_plain_phone>[2-9]\d\d[2-9]\d{6})(?!\d|[\-.]\d)", phone),
    "phone": (r"(?<![\d.\w])(?:(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|\+(?!1\b)\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5})(?![\d\-]|\.\d)", phone),
    "card": (r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-]|\.\d)", card),
}
_PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, (pattern, _) in KINDS.items()))
_HINT = re.compile(r"[0-9@]")
_VERSION = re.compile(r"(?:\bv|\bver|version|release|build|section|chapter)[ .:]{0,2}$", re.IGNORECASE)  # no address follows these


def pseudonymise(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of what was replaced, in order."""
    if not _HINT.search(text) and "=" not in text and ":" not in text:
        return text, []
    kinds: list[str] = []

    def swap(m: re.Match) -> str:
        kind = next(k for k in KINDS if m.group(k) is not None)
        own = f"own_{kind}"
        whole = m.group()
        a, b = (m.start(own) - m.start(), m.end(own) - m.start()) if own in _PATTERN.groupindex and m.group(own) is not None else (0, len(whole))
        new = None if kind == "ipv4" and _VERSION.search(text, max(0, m.start() - 10), m.start()) else _known(kind, whole[a:b], key)
        if new is None:
            return whole
        kinds.append(kind)
        return whole[:a] + new + whole[b:]

    return _PATTERN.sub(swap, text), kinds


@lru_cache(maxsize=50_000)
def _known(kind: str, value: str, key: bytes) -> str | None:
    return KINDS[kind][1](value, key)


def pseudonymise_column(df: DataFrame, text: str = "text", key: bytes | None = None, kinds: str = "pii_kinds") -> DataFrame:
    """Replace personal data in column ``text`` and add ``kinds``, the array of what was replaced, in order.

    Without ``key`` that of the Spark setting ``spark.corvane.pseudonym.key`` is taken; where none is set, a key for tests, with a
    warning. A null text stays null with a null array; an empty one stays empty. All else of the text is kept, and its
    length too but for the widths of an IPv4 address's numbers and of dates written without leading zeros. Whole texts are read,
    however long. Repeated rows get equal texts. A column named ``kinds`` is replaced. An empty table gives an empty one.
    """
    if key is None:
        key = df.sparkSession.conf.get(KEY_SETTING, "").encode()
        if not key:
            warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with the key for tests", stacklevel=2)
            key = TEST_KEY
    kept = [f for f in df.schema.fields if f.name != kinds]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(kinds, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, None) if t is None else pseudonymise(t, key) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            new = pa.array([t for t, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([*(new if n == text else batch.column(batch.schema.get_field_index(n)) for n in names), pa.array([k for _, k in got], pa.list_(pa.string()))], names=[*names, kinds])

    return df.mapInArrow(released(run), schema)


def op10_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise_column(docs).select("doc_id", "text", F.coalesce(F.size("pii_kinds"), F.lit(0)).cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))
