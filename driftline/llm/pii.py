"""Operator 10, PII: format-preserving Feistel pseudonyms.

Numbers and dates that validate, and the local parts of e-mail addresses, are replaced by a keyed permutation of
their own domain: a card number becomes a card number of the same length, separators and Luhn remainder, an IPv4 address an
address, a date a date. As it is a permutation under one key, equal values get equal pseudonyms in every document
and different values different ones. A Feistel network of ROUNDS rounds permutes pairs (a, b) of Z_m x Z_k, its
round function SHA-256 of key, kind, round and half; every domain is such a product, so no value is left out.

Main path: DataFrame functions alone; all is done inside a row and nothing is shuffled.

Kinds: card and other numbers of 13 to 19 digits (payload permuted, distance of the check digit kept); North
American style phone numbers, country code and brackets optional, groups apart by blank, point or hyphen (national digits); phone numbers
of 8 to 15 digits with + and a country code, whatever their groups (the digits after the code, and after "(0)"); IPv4; IPv6 (whole or with "::" after a first group, all
128 bits, written out in lower case); social security numbers (area 001-899 but 666, group 01-99, serial 0001-9999); dates as YYYY-MM-DD, D.M.YYYY or D/M/YYYY, zeros in front or not, in the
72,900 days from 1900-01-01, and what D/M/YYYY can't be but M/D/YYYY in 1900 to 2099 (among such dates alone, 29 February among its kind; other dates stay); e-mail local parts
(digits and letters permuted each within its class of CLASSES; addresses with a letter or mark of no class stay as a whole).

Defined results: null and empty texts hold nothing; repeated rows are rewritten each alike; a null id stays null;
an empty table gives no rows; of further columns `pseudonymised` reads none and `rewrite` keeps all.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.native import found_in, rebuilt

ROUNDS, EPOCH, DAYS = 8, "1900-01-01", 270
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
_CODE, _NUMBER = r"(?:\+?[0-9]{1,3}[ .\-]?)", r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
#: The first and last code point of the classes within which an e-mail's characters are permuted.
CLASSES = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xE0, 0xF6), (0xF8, 0xFE), (0x100, 0x17F), (0x300, 0x36F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F),
    (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)
_LETTERS = "".join(f"{chr(a)}-{chr(b)}" for a, b in CLASSES)
#: How country codes begin; those that aren't here have three digits.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Days (MM/DD) that can't be read as DD/MM, but for 29 February.
_US_DAYS = [f"{m:02}/{d:02}" for m in range(1, 13) for d in range(13, calendar.monthrange(1901, m)[1] + 1)]
#: kind, how it looks in a text; earlier ones win. None has inner groups.
FORMS = (
    ("email", rf"(?=[^\s@]{{1,64}}+@)[{_LETTERS}._%+\-]{{1,64}}+@[A-Za-z0-9\-]{{1,63}}(?:\.[A-Za-z0-9\-]{{1,63}}){{0,8}}\.[A-Za-z]{{2,24}}"),
    ("phone", rf"{_CODE}?\([0-9]{{3}}\)[ .\-]?[0-9]{{3}}[ .\-]?[0-9]{{4}}|(?!{_NUMBER})(?:\+[0-9]{{1,3}}[ .\-]?|[0-9]{{1,3}}[ .\-])?[0-9]{{3}}[ .\-][0-9]{{3}}[ .\-]?[0-9]{{4}}(?![0-9])"),
    ("phone_abroad", r"\+[0-9]{10,15}(?![0-9])|\+[0-9](?:[ .\-/]?\(?[0-9]\)?){7,14}(?<=[0-9]{2})(?![0-9])"),
    ("ip6", rf"(?={_GROUP}:)(?<![0-9A-Fa-f:]:)(?=[A-Fa-f:]{{0,32}}[0-9])(?:{_GROUP}(?::{_GROUP}){{7}}|{_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\p{{L}}\p{{N}}]|:[0-9A-Fa-f:]|\.[0-9])"),
    ("ip", rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?!\.?[0-9])"),
    ("date_iso", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"),
    ("date_dot", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])"),
    ("date_slash", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("number", _NUMBER),
)
#: Java looks behind by whole code points only if the pattern holds one beyond U+FFFF.
BEFORE = "(?<![\U00010000" + r"\p{L}\p{M}\p{N}._%+\-])"
ANY = BEFORE + "(?:" + "|".join(p for _, p in FORMS) + ")"
#: What a text must hold to be looked at in full; every form implies it.
HINT = r"[0-9][ .\-/]?\(?[0-9]|@|[0-9A-Fa-f]:[0-9A-Fa-f:]"


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, m, k, key: str, kind: str) -> Column:
    """A permutation of Z_m x Z_k: struct a, b."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("bigint")
    m, k = lit(m), lit(k)

    def turn(s: Column, r: Column) -> Column:
        def beside(x: Column) -> Column:
            return _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m.cast("string"), k.cast("string"), r.cast("string"), x.cast("string")), 256))

        even = r % 2 == 0
        return F.struct(F.when(even, (s["a"] + beside(s["b"])) % m).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + beside(s["a"])) % k).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("bigint")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of one length (2 to 36)."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    halves = feistel(F.left(digits, left).cast("bigint"), F.right(digits, right).cast("bigint"), _power(left), _power(right), key, kind)
    return _let(halves, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), right, F.lit("0"))))


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one after another, by those of `digits`."""
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def _check_digit(payload: Column) -> Column:
    return F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(payload, c.cast("string")))), 1)


def _as_number(v: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        old = F.left(d, F.length(d) - 1)
        far = (F.right(d, F.lit(1)).cast("int") - _check_digit(old) + 10) % 10
        return _let(permuted_digits(old, key, "number"), lambda new: F.concat(new, ((_check_digit(new) + far) % 10).cast("string")))

    return refilled(v, _let(_digits(v), of))


def _as_phone(v: Column, key: str) -> Column:
    code = F.regexp_extract(v, r"^(.*?)\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}$", 1)
    rest = F.substr(v, F.length(code) + 1)
    return F.concat(code, refilled(rest, permuted_digits(_digits(rest), key, "phone")))


def _as_phone_abroad(v: Column, key: str) -> Column:
    code = F.regexp_extract(v, rf"^\+(?:{_COUNTRY}|[0-9]{{3}}|[0-9]{{1,2}}(?![0-9]))[ .\-/]*(?:\(0\)[ .\-/]*)?", 0)
    rest = F.substr(v, F.length(code) + 1)
    valid = F.length(_digits(v)).between(8, 15) & (F.length(_digits(rest)) > 1)
    return F.when(valid, F.concat(code, refilled(rest, permuted_digits(_digits(rest), key, "phone")))).otherwise(v)


def _as_ip(v: Column, key: str) -> Column:
    o = F.split(v, r"\.")
    part = lambda i: F.element_at(o, i).cast("bigint")
    s = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ip")
    return _let(s, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))


def _as_ip6(v: Column, key: str) -> Column:
    own = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    head, tail = own(F.substring_index(v, "::", 1)), own(F.when(v.contains("::"), F.substring_index(v, "::", -1)).otherwise(""))
    zeros = 8 - F.size(head) - F.size(tail)
    groups = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), tail)
    whole = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    half = lambda x: F.conv(x, 16, -10).cast("bigint")

    def turn(s: Column, r: Column) -> Column:
        beside = lambda x: half(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip6"), r.cast("string"), x.cast("string")), 256), 1, 16))
        even = r % 2 == 0
        return F.struct(F.when(even, s["a"].bitwiseXOR(beside(s["b"]))).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(s["b"].bitwiseXOR(beside(s["a"]))).alias("b"))

    def shown(s: Column) -> Column:
        digits = F.lower(F.concat(*[F.lpad(F.hex(s[k]), 16, "0") for k in "ab"]))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")

    start = F.struct(half(F.left(whole, F.lit(16))).alias("a"), half(F.right(whole, F.lit(16))).alias("b"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, shown)
    return F.when((v.contains("::") & (zeros > 0)) | (zeros == 0), new).otherwise(v)


def _as_ssn(v: Column, key: str) -> Column:
    part = lambda at, n: F.substring(v, at, n).cast("bigint")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def shown(s: Column) -> Column:
        i = F.floor(s["a"] / 99)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(F.when(i >= 665, i + 2).otherwise(i + 1), 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

    return F.when(valid, _let(s, shown)).otherwise(v)


def _as_date(v: Column, key: str, form: str) -> Column:
    """form as it is with zeros in front; without them in v, there are none in what comes out."""
    short = form.replace("dd", "d").replace("MM", "M")
    day = F.datediff(F.try_to_timestamp(v, F.lit(short)).cast("date"), F.lit(EPOCH).cast("date"))
    s = feistel(F.floor(day / DAYS), day % DAYS, DAYS, DAYS, key, "date")
    padded = v.rlike("^(?:[0-9]{4}-|[0-9]{2}[./][0-9]{2}[./])")

    def shown(s: Column) -> Column:
        new = F.date_add(F.lit(EPOCH).cast("date"), (s["a"] * DAYS + s["b"]).cast("int"))
        return F.when(padded, F.date_format(new, form)).otherwise(F.date_format(new, short))

    return F.when((day >= 0) & (day < DAYS * DAYS), _let(s, shown)).otherwise(v)


def _as_slash_date(v: Column, key: str) -> Column:
    parts, days = F.split(v, "/"), F.array(*map(F.lit, _US_DAYS))
    part = lambda i: F.lpad(F.element_at(parts, i), 2, "0")
    year, month_day = F.element_at(parts, 3).cast("bigint"), F.concat(part(1), F.lit("/"), part(2))
    at = F.array_position(days, month_day) - 1

    def shown(month_day: Column, year: Column) -> Column:
        return F.concat(F.when(F.length(F.element_at(parts, 1)) == 2, month_day).otherwise(F.regexp_replace(month_day, "^0", "")), F.lit("/"), year.cast("string"))

    leap = (month_day == "02/29") & (year % 4 == 0) & (year > 1900)
    common = _let(feistel(year - 1900, at, 200, len(_US_DAYS), key, "us_date"), lambda s: shown(F.element_at(days, (s["b"] + 1).cast("int")), s["a"] + 1900))
    rare = _let(feistel(F.floor((year - 1904) / 28), F.floor((year - 1904) / 4) % 7, 7, 7, key, "us_leap_day"), lambda s: shown(F.lit("02/29"), 1904 + 4 * (7 * s["a"] + s["b"])))
    within = year.between(1900, 2099)
    return F.when(within & (at >= 0), common).when(within & leap, rare).otherwise(_as_date(v, key, "dd/MM/yyyy"))


def _as_email(v: Column, key: str) -> Column:
    local = F.regexp_extract(v, "^[^@]*", 0)
    chars = F.split(local, "")
    half = F.floor((F.size(chars) + 1) / 2).cast("int")

    def moved(own: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.size(own).cast("string"), r.cast("string"), F.array_join(other, "")), 256)

        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(digest, (i * 4) % 60 + 1, F.lit(4)), 16, 10).cast("int")
            code, new = F.ascii(c), F.lit(None).cast("int")
            for a, b in reversed(CLASSES):
                new = F.when(code.between(a, b), (code - a + by + i) % (b - a + 1) + a).otherwise(new)
            return F.when(new.isNull(), c).otherwise(F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE"))

        return F.transform(own, one)

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], r)).alias("b"))

    start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))
    return F.concat(new, F.substr(v, F.length(local) + 1))


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one value as ANY finds it; what doesn't validate stays."""
    makers = {"email": _as_email, "phone": _as_phone, "phone_abroad": _as_phone_abroad, "ip6": _as_ip6, "ip": _as_ip, "ssn": _as_ssn, "number": _as_number, "date_iso": lambda v, k: _as_date(v, k, "yyyy-MM-dd"), "date_dot": lambda v, k: _as_date(v, k, "dd.MM.yyyy"), "date_slash": _as_slash_date}
    out = None
    for kind, form in FORMS:
        fits = v.rlike(f"^(?:{form})$")
        out = F.when(fits, makers[kind](v, key)) if out is None else out.when(fits, makers[kind](v, key))
    return out.otherwise(v)


def rewritten(text: Column, key: str) -> tuple[Column, Column]:
    """The text with pseudonyms, and how many values they replace; null for a text without any."""
    values, gaps = found_in(text, ANY)
    looked = text.rlike(HINT) & text.rlike(ANY)
    new = F.transform(values, lambda v: pseudonym(v, key))
    both = F.when(looked, _let(new, lambda n: F.struct(rebuilt(gaps, n).alias("text"), F.size(F.filter(F.zip_with(values, n, lambda a, b: a != b), lambda x: x)).alias("n"))))
    return both["text"], both["n"]


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_values, text for each document that holds values; the others have none to replace."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("text").rlike(HINT) & F.col("text").rlike(ANY))
    text, n = rewritten(F.col("text"), key)
    return docs.select("doc_id", n.alias("n_values"), text.alias("text")).where("n_values > 0")


def rewrite(docs: DataFrame, key: str) -> DataFrame:
    """docs with the pseudonyms in `text`; n_chars, if there, follows."""
    out = docs.withColumn("text", F.coalesce(rewritten(F.col("text"), key)[0], F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
