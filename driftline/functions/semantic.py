"""What a column means: rules on its name, tests on its values, and the vote of a spread sample."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
SAMPLE, MAJORITY = 100, 0.8
#: Fixed values, tested in this order: the type and the pattern its values match in full.
PATTERNS = {
    "Email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+",
    "CreditCard": r"(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})",
    "PhoneNumber": r"\+?[1-9]\d{1,14}",
    "UUID": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "IPAddress": r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    "Url": r"https?://[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+(:[0-9]{1,5})?(/\S*)?",
}
#: Fixed values, first match wins: what a lower-cased name contains, or has as a segment between other characters than letters and digits.
NAMES = (("Email", ("email",), ()), ("CreditCard", ("credit_card", "cc_number"), ()), ("PhoneNumber", ("phone",), ()), ("UUID", ("uuid",), ()), ("IPAddress", (), ("ip",)), ("Url", ("url", "website"), ()))
PHONE_HINTS = (("mobile", "msisdn", "fax", "telephone"), ("tel", "cell"))


def _names(name: str, parts, segments) -> bool:
    low = name.lower()
    return any(p in low for p in parts) or any(s in segments for s in re.split(r"[\W_]+", low))


def from_name(name: str) -> str:
    """The type that a column's name alone tells."""
    return next((kind for kind, parts, segments in NAMES if _names(name, parts, segments)), UNKNOWN)


def hints_phone(name: str) -> bool:
    return _names(name, *PHONE_HINTS)


#: White space as the patterns' \S understands it, beyond Java's own.
_BLANK = r"[^\s\x0B\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _full(v: Column, pattern: str) -> Column:
    return v.rlike(rf"\A(?:{pattern})\z".replace(r"\S", _BLANK))


def is_ipv6(v: Column) -> Column:
    """Eight groups of hex digits, or fewer around one "::"; the last two may stand as an IPv4 address."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v = F.regexp_replace(v, rf"(?<=:){octet}(\.{octet}){{3}}\z", "0:0")
    group = "[0-9a-fA-F]{1,4}"
    some = rf"({group}(:{group})*)?"
    groups = F.size(F.array_remove(F.split(v, ":"), ""))
    return _full(v, rf"({group}:){{7}}{group}") | (_full(v, f"{some}::{some}") & (groups <= 7))


def stripped_phone(v: Column) -> Column:
    """A value of digits, +, spaces, hyphens and parentheses without the last three; null for others."""
    return F.when(v.rlike(r"\A[0-9+ ()-]*\z"), F.regexp_replace(v, "[ ()-]", ""))


def value_type(v: Column) -> Column:
    """The first type whose test a value passes, else Unknown; null stays null."""
    tests = {
        "Email": _full(v, PATTERNS["Email"]),
        "CreditCard": _full(v, PATTERNS["CreditCard"]) & F.call_function("luhn_check", v),
        "PhoneNumber": F.coalesce(_full(stripped_phone(v), PATTERNS["PhoneNumber"]), F.lit(False)),
        "UUID": _full(v, PATTERNS["UUID"]),
        "IPAddress": _full(v, PATTERNS["IPAddress"]) | is_ipv6(v),
        "Url": _full(v, PATTERNS["Url"]),
    }
    out = F.when(v.isNull(), None)
    for kind, test in tests.items():
        out = out.when(test, kind)
    return out.otherwise(UNKNOWN)


def spread(index: Column, length: int, size: int = SAMPLE) -> Column:
    """Whether a row is one of the `size` that lie evenly over `length` rows: floor(k * length / size) for k = 0, 1 ..."""
    s = min(size, length)
    return index.isin([k * length // s for k in range(s)]) if s else F.lit(False)


def winner(name: str, counts: dict[str, int], total: int) -> str:
    """The first type, in order, that at least MAJORITY of the non-null sample has; phone numbers need a hint in the name too."""
    for kind in PATTERNS:
        if total and counts.get(kind, 0) / total >= MAJORITY and (kind != "PhoneNumber" or hints_phone(name)):
            return kind
    return UNKNOWN
