"""Format-preserving pseudonyms for personal data; DataFrame operations only.

One pattern finds e-mail addresses, network addresses, phone, card and social security numbers and
dates. What passes its kind's validation is permuted within the set of valid values of its format by
a keyed Feistel network: two halves, each in turn shifted by a digest of the key and the other half.
A permutation maps equal values to equal pseudonyms in every document and different ones to
different ones, and nothing has to be remembered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import once

ROUNDS = 8  # even: the halves end in their places
KEY = "pseudonym-key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
US_DATE = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
DOT_DATE = r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?![\d]|\.\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d+(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
# all but e-mail addresses begin with one of three signs, which spares most places their searches
NUMBERS = r"(?=[\d+(])(?:" + "|".join(f"(?:{p})" for p in (ADDRESS, ISO_DATE, US_DATE, DOT_DATE, SOCIAL, PHONE, CARD)) + ")"
FOUND = f"(?:{EMAIL})|{NUMBERS}"
KINDS = ("email", "address", "date", "social", "phone", "card")


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of pairs (left < a, right < b), as a struct (l, r)."""

    def moved(given: Column) -> Column:
        a, b = given["a"], given["b"]

        def step(acc: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, a, b, acc["r"]), 256)
            size = F.when(i % 2 == 1, a).otherwise(b)
            return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + _number(digest) % size, size).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(given["l"].alias("l"), given["r"].alias("r")), step)

    return once(F.struct(a.alias("a"), b.alias("b"), left.cast("long").alias("l"), right.cast("long").alias("r")), moved)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (2 to 24)."""

    def moved(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        halves = feistel(F.substring(d, F.lit(1), a), F.substring(d, a + 1, n), _ten(a), _ten(n - a), key, kind)
        return once(halves, lambda out: F.concat(F.lpad(out["l"].cast("string"), a, "0"), F.lpad(out["r"].cast("string"), n - a, "0")))

    return once(digits, moved)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""

    def filled(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c = F.substring(shape, i, F.lit(1))
            is_digit = c.between("0", "9")
            return F.struct(
                F.concat(acc["s"], F.when(is_digit, F.substring(d, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
                (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))

        begin = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
        return F.aggregate(F.sequence(F.lit(1), F.length(shape)), begin, step, lambda acc: acc["s"])

    return once(digits, filled)


def luhn_sum(digits: Column) -> Column:
    """Checksum of digits whose last one is the check digit; null for none."""

    def total(given: Column) -> Column:
        n = F.length(given)

        def step(acc: Column, i: Column) -> Column:
            d = F.substring(given, i, F.lit(1)).cast("int")
            doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return acc + F.when((n - i) % 2 == 1, doubled).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)

    return once(digits, total)


def permute_card(m: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the check digit made to fit."""

    def checked(body: Column) -> Column:
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
        return F.concat(body, check.cast("string"))

    body = lambda d: F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    return refill(m, once(once(_digits(m), body), checked))


# Fixed values of the public numbering plan: 1 and 7 are codes of one digit, these of two, all others have three.
CALLING_CODES = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def permute_phone(m: Column, key: str) -> Column:
    """Country code kept, the national number permuted in whatever way the number is written.

    North American numbers stay valid, others keep their number of digits. Without a plus there is no
    country code, but for eleven digits that begin with 1.
    """
    whole = _digits(m)
    code = F.when(m.startswith("+"), F.regexp_extract(whole, f"^{CALLING_CODES}", 0)).when(whole.rlike(r"^1\d{10}$"), "1").otherwise("")

    def moved(x: Column) -> Column:
        code, national = x["code"], F.substring(x["whole"], F.length(x["code"]) + 1, F.length(x["whole"]))
        area, exchange, line = (F.substring(national, F.lit(p), F.lit(k)).cast("long") for p, k in ((1, 3), (4, 3), (7, 4)))
        american = (F.length(national) == 10) & code.isin("1", "") & (area >= 200) & (exchange >= 200)
        pair = feistel(area - 200, (exchange - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000), key, "phone")
        us = once(pair, lambda out: F.concat((out["l"] + 200).cast("string"), F.lpad((out["r"] + 2_000_000).cast("string"), 7, "0")))
        return F.concat(code, F.when(american, us).otherwise(permute_digits(national, key, "phone")))

    return refill(m, once(F.struct(code.alias("code"), whole.alias("whole")), moved))


def permute_social(m: Column, key: str) -> Column:
    """Another valid number: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(place, (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(99 * 9_999), key, "social")

    def shown(out: Column) -> Column:
        area = out["l"] + 1 + F.when(out["l"] >= 665, 1).otherwise(0)
        parts = ((area, 3), (F.floor(out["r"] / 9_999) + 1, 2), (out["r"] % 9_999 + 1, 4))
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in parts))

    return once(pair, shown)


def permute_address(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    halves = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "address")
    return once(halves, lambda out: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(out[h] / 256), out[h] % 256))))


# (first day, first size, second size): the sizes' product is the number of days
ERAS = (("1900-01-01", 270, 271), ("1000-01-01", 1057, 311))


def _day(m: Column, pattern: str) -> Column:
    return F.try_to_timestamp(m, F.lit(pattern)).cast("date")


def _joined(size: int) -> Callable[[Column], Column]:
    return lambda pair: (pair["l"] * size + pair["r"]).cast("int")


def permute_date(m: Column, pattern: str, key: str) -> Column:
    """Another day of the same era (1900 to spring 2100, 1000 to 1899); other days stay."""

    def moved(day: Column) -> Column:
        out = m
        for begin, a, b in reversed(ERAS):
            first = F.lit(begin).cast("date")
            days = F.datediff(day, first)
            at = once(feistel(F.floor(days / b), days % b, F.lit(a), F.lit(b), key, "date"), _joined(b))
            out = F.when(days.between(0, a * b - 1), F.date_format(F.date_add(first, at), pattern)).otherwise(out)
        return out

    return once(_day(m, pattern), moved)


def permute_email(m: Column, key: str) -> Column:
    """Letters and digits of the local part shifted within their classes; the domain stays."""

    def shifted(part: Column, digest: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(part, i, F.lit(1))
            k = F.conv(F.substring(digest, 2 * ((i - 1) % 32) + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda base, size: F.char(F.lit(base) + (F.ascii(c) - base + k) % size)
            return F.when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("0", "9"), turn(48, 10)).otherwise(c)

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), one), ""))

    def moved(local: Column) -> Column:
        half = F.floor(F.length(local) / 2).cast("int")

        def step(acc: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i, F.length(local), acc["r"]), 256)
            return F.struct(acc["r"].alias("l"), once(digest, lambda d: shifted(acc["l"], d)).alias("r"))

        begin = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda acc: F.concat(acc["l"], acc["r"]))

    return F.concat(once(F.split_part(m, F.lit("@"), F.lit(1)), moved), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2)))


def _is(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def kind_of(m: Column) -> Column:
    """Kind of a match that passes its validation, else null."""
    octets = _is(m, r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}")
    day = F.coalesce(*(F.when(_is(m, p), _day(m, f)) for p, f in DATES))
    n = F.length(_digits(m))
    valid_card = n.between(13, 19) & F.coalesce(luhn_sum(_digits(m)) % 10 == 0, F.lit(False))
    return (
        F.when(m.contains("@"), "email").when(octets, "address").when(day.isNotNull(), "date")
        .when(_is(m, r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"), "social")
        .when(_is(m, PHONE) & n.between(7, 15), "phone").when(_is(m, CARD) & valid_card, "card"))


DATES = ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"), (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    dates = F.coalesce(*(F.when(_is(m, p), permute_date(m, f, key)) for p, f in DATES))
    return F.coalesce(
        F.when(kind == "email", permute_email(m, key)).when(kind == "address", permute_address(m, key)).when(kind == "date", dates)
        .when(kind == "social", permute_social(m, key)).when(kind == "phone", permute_phone(m, key)).when(kind == "card", permute_card(m, key)), m)


def _count(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values replaced per kind; one row per row.

    Null text stays null with counts of 0, empty text stays empty; repeated rows repeat. Values that
    fail their validation (checksum, calendar, ranges) stay as they are, and so do all other
    characters. Dates after spring 2100 and days written before months with slashes stay.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    at = F.contains("text", F.lit("@"))  # no other texts hold e-mail addresses
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = rows.withColumn("found", F.when(at, found(FOUND)).when(F.regexp_like("text", F.lit(r"\d")), found(NUMBERS)))
    before = F.when(at, F.split("text", FOUND, -1)).otherwise(F.split("text", NUMBERS, -1))
    none = F.array().cast("array<struct<before:string,g0:string>>")
    rows = rows.withColumn("parts", F.when(F.size("found") > 0, F.arrays_zip(before.alias("before"), F.col("found").alias("g0"))).otherwise(none)).drop("found")
    typed = F.transform("parts", lambda x: F.struct(x["before"].alias("before"), x["g0"].alias("g0"), kind_of(x["g0"]).alias("kind")))
    rows = rows.withColumn("typed", typed)
    filled = F.array_join(F.transform("typed", lambda x: F.concat(x["before"], F.coalesce(pseudonym(x["g0"], x["kind"], key), F.lit("")))), "")
    kinds = F.transform("typed", lambda x: x["kind"])
    counts = [_count(kinds, k) for k in KINDS]
    return rows.select("doc_id", F.when(F.size("parts") > 0, filled).otherwise(F.col("text")).alias("text"), *counts)
