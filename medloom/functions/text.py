"""Column expressions for text cleaning. All JVM-side except ``nfkc``."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv


def fold_case(c: Column) -> Column:
    """Lower case with the foldings ``lower`` leaves out: sharp s, long s, final sigma."""
    for letter, folded in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):
        c = F.replace(F.lower(c) if letter == "ß" else c, F.lit(letter), F.lit(folded))  # searched, not mapped letter by letter
    return c


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normalisation; the only function here with no JVM counterpart."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def _latin_base_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from Unicode decompositions."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(
            ch for ch in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(ch)
        )
        if len(base) == 1 and base.isascii():
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _BASE = _latin_base_letters()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), "[̀-ͯ]", "")


def snake(name: str) -> str:
    """Header to snake case (driver-side, schema only)."""
    out, gap = [], False
    for ch in name.casefold():
        if ch.isascii() and ch.isalnum():
            if gap and out:
                out.append("_")
            out.append(ch)
            gap = False
        else:
            gap = True
    return "".join(out)


# --- dosha codes -------------------------------------------------------------------------------
def dosha_code(c: Column) -> Column:
    """Canonical code; NULL when no dosha is named."""
    text = fold_case(c.cast("string"))
    named = F.concat_ws("-", *[F.when(text.contains(d), F.lit(d)) for d in fv.DOSHAS])
    return (
        F.when(text.contains("tridosha") | text.contains("sannipata"), F.lit("tridosha"))
        .when(named == "-".join(fv.DOSHAS), F.lit("tridosha"))
        .when(named != "", named)
    )


def dosha_components(code: Column) -> Column:
    return (
        F.when(code.isNull(), F.array().cast("array<string>"))
        .when(code == "tridosha", F.array(*[F.lit(d) for d in fv.DOSHAS]))
        .otherwise(F.split(code, "-"))
    )


# --- body system -------------------------------------------------------------------------------
def body_system(c: Column, strict: bool = False) -> Column:
    """First token that meets an alias, aliases in their fixed order.

    ``strict`` asks for whole words, so that "heart" no longer meets "ear".
    """

    def first_alias(token: Column) -> Column:
        chain = F
        for alias, system in fv.SYSTEM_ALIASES:
            hit = token.rlike(rf"\b{alias}\b") if strict else token.contains(alias)
            chain = chain.when(hit, F.lit(system))
        return chain

    tokens = F.split(fold_case(c), r"[/,&]| and ")
    hits = F.filter(F.transform(tokens, first_alias), lambda s: s.isNotNull())
    return F.when(c.isNull(), F.lit("unspecified")).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit("other")))


# --- symptom phrases ---------------------------------------------------------------------------
def split_mentions(c: Column) -> Column:
    """Raw fragments of a symptom text; the word separators are case-sensitive.

    A separator's letters are met before its word bounds are asked for, which most places then are not.
    """
    bare = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.split(bare, r"[,;/•\n]|and(?<=\band)\b|with(?<=\bwith)\b")


def tidy_phrase(c: Column) -> Column:
    """Character set, spacing, leading qualifiers and spelling (before synonyms)."""
    folded = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))  # a sigma becomes a space below
    p = F.regexp_replace(folded, r"[^a-z0-9\s\-']", " ")
    p = F.btrim(F.regexp_replace(p, r"\s{2,}|[^\S ]", " "), F.lit(" -'"))
    p = F.regexp_replace(p, "^(?:(?:" + "|".join(fv.QUALIFIERS) + r")\s+)+", "")
    for pattern, replacement in fv.SPELLING:
        p = F.replace(p, F.lit(pattern), F.lit(replacement)) if pattern.isalpha() else F.regexp_replace(p, pattern, replacement)
    return p


def is_symptom(p: Column) -> Column:
    return (F.length(p) >= 3) & ~p.isin(*fv.DESCRIPTORS) & ~p.rlike("^[0-9]+$")


# --- phonetic key ------------------------------------------------------------------------------
def phonetic_key(c: Column) -> Column:
    t = fold_case(strip_accents(F.element_at(F.split(c, r"\("), 1)))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z]", ""), "(ah|h|am|m)$", "")
    for long, short in fv.PHONETIC_FOLDS:
        t = F.replace(t, F.lit(long), F.lit(short))
    return F.coalesce(F.regexp_replace(t, "a+$", ""), F.lit(""))


def phonetic_tags(key: Column) -> Column:
    return F.concat_ws("+", *[F.when(key.contains(mark), F.lit(tag)) for mark, tag in fv.PHONETIC_TAGS])


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold_case(c), "[^a-z0-9]+", " "))


# --- keyed pseudonyms --------------------------------------------------------------------------
def identity_text(c: Column, ascii_only: bool = False) -> Column:
    text = c.cast("string") if ascii_only else nfkc(c.cast("string"))
    return F.trim(F.regexp_replace(fold_case(text), r"[\s\u0085\u001c-\u001f]+", " "))


def hmac_pads(salt: str) -> tuple[str, str]:
    """Hex of the inner and outer key pads of HMAC-SHA256 (RFC 2104)."""
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message: Column, salt: str) -> Column:
    """Keyed digest built from two ``sha2`` calls, so it stays inside code generation."""
    inner_pad, outer_pad = hmac_pads(salt)
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)


def pseudonym(c: Column, salt: str, length: int = 16, ascii_only: bool = False) -> Column:
    digest = hmac_sha256(identity_text(c, ascii_only), salt)
    return F.concat(F.lit("p_"), F.substring(digest, 1, length))
