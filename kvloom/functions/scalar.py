"""Scalar functions as native columns."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hash_key(value: Column) -> Column:
    """SHA-256 as bytes; a null value is an error, since a row without a key cannot be stored."""
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("a key hash needs a value")))
    return F.unhex(F.sha2(checked.cast("binary"), 256))


def collate(value: Column, collation: str = "NONE") -> Column:
    """The form of a text under which equal values hash alike."""
    text = value.cast("string")
    if collation == "NOCASE":
        return F.translate(text, ASCII_LOWER, ASCII_UPPER)
    if collation == "RTRIM":
        return F.rtrim(text)
    if collation != "NONE":
        raise ValueError(f"unknown collation {collation!r}")
    return text


def hash_hex(value: Column, collation: str = "NONE") -> Column:
    return F.sha2(collate(value, collation).cast("binary"), 256)


def composite_hash(*columns: Column, collations: tuple[str, ...] = ()) -> Column:
    """Hash of several key columns: each is hashed, and the joined digests are hashed again; one
    column is hashed once."""
    kinds = collations or ("NONE",) * len(columns)
    if len(columns) == 1:
        return hash_hex(columns[0], kinds[0])
    digests = [F.unhex(hash_hex(c, k)) for c, k in zip(columns, kinds)]
    return F.sha2(F.concat(*digests), 256)


def regexp_match(pattern: Column | str, text: Column) -> Column:
    """1 if the whole text matches, 0 if not, null for nulls."""
    if isinstance(pattern, str):
        return text.rlike(rf"\A(?:{pattern})\z").cast("int")
    return F.rlike(text, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z"))).cast("int")


def glob(text: Column, pattern: str) -> Column:
    """Case-sensitive match of ``*``, ``?`` and ``[...]`` over the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("]", "^") else i + 1) if c == "[" else -1
        if c == "*":
            out.append(r"[\s\S]*")
        elif c == "?":
            out.append(r"[\s\S]")
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{inner}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return text.rlike(f"^{''.join(out)}\\z")


def cast_number(text: Column, kind: str) -> Column:
    """A cast that never fails: the leading number of a text, 0 if it has none, null for null."""
    pattern = r"^\s*([+-]?\d+)" if kind == "bigint" else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    found = F.regexp_extract(text.cast("string"), pattern, 1)
    number = F.when(found != "", found).try_cast(kind)
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0).cast(kind)))


def json_object(**columns: Column) -> Column:
    """A JSON object that keeps null members."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


def same_entity(a: Column, b: Column) -> Column:
    """1 if two JSON texts are equal whatever their blanks; both null is equal, one null is not."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    equal = F.coalesce(plain(a) == plain(b), a == b, F.lit(False))
    return F.when(a.isNull() & b.isNull(), 1).when(a.isNull() | b.isNull(), 0).otherwise(equal.cast("int"))


def has_bits(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


class Clock:
    """Times in 100 ns ticks that never repeat or go back."""

    def __init__(self, last: int = 0):
        self.last = last

    def raw(self) -> int:
        return time.time_ns() // 100

    def now(self, offset: int = 0) -> int:
        self.last = max(self.last + 1, self.raw() + offset)
        return self.last


def time_offset(start: Column, seen: Column, answered: Column, end: Column) -> Column:
    """Offset of the other side's clock from a ping's four times: the round trip is halved."""
    trip = (end - start) - (answered - seen)
    return ((seen - start) - trip / 2) / 2 + ((answered - end) + trip / 2) / 2
