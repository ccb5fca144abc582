"""Pseudonyms in all spellings and ranges; places of very many matches; licence words."""

import re
import time

import regex
from pyspark.sql import functions as F

from medloom.llm import licenses, pii, secrets, spans


def _moved(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows).collect()}
    return [out[i] for i in range(len(values))]


def test_one_phone_number_has_one_pseudonym_in_all_spellings(spark):
    for code, spellings in (
        ("1", ["+1 (389) 555-5010", "+13895555010", "+1 389 555 5010", "+1-389-555-5010", "(389) 555-5010", "389-555-5010", "389.555.5010"]),
        ("49", ["+49 151 1234567", "+491511234567", "+49-151-1234567"]),
        ("7", ["+7 495 123 4567", "+74951234567"]),
        ("44", ["+44 20 7946 0958", "+442079460958"]),
        ("358", ["+358 40 123 4567", "+358401234567"]),
    ):
        new = _moved(spark, spellings)
        shape = lambda s: re.sub(r"\d", "9", s)
        assert [shape(a) for a in spellings] == [shape(b) for b in new]
        digits = [re.sub(r"\D", "", s) for s in new]
        national = {d[len(code):] if s.startswith("+") else d for s, d in zip(spellings, digits)}
        assert len(national) == 1 and all(d.startswith(code) for s, d in zip(spellings, digits) if s.startswith("+"))
        assert new[0] != spellings[0]


def test_social_numbers_stay_valid_and_different(spark):
    given = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 78, 665, 667, 899) for g in (1, 45, 99) for s in (1, 1234, 9999)]
    new = _moved(spark, given)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", v) for v in new)
    assert len(set(new)) == len(given) and sum(a == b for a, b in zip(given, new)) < 2
    assert _moved(spark, ["666-12-3456", "000-12-3456", "123-00-3456", "123-45-0000"]) == ["666-12-3456", "000-12-3456", "123-00-3456", "123-45-0000"]


def test_pseudonyms_of_odd_rows(spark):
    text = "call +491511234567 " * 3_000
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, "123-45-6789", "y"), (2, None, None)], "doc_id long, text string, found string")
    rows = rows.withColumn("parts", F.lit(1)).withColumn("typed", F.lit(2))
    out = pii.pseudonymise(rows).collect()
    long = [r for r in out if r["doc_id"] == 1]
    assert len(out) == 4 and long[0] == long[1] and long[0]["n_phone"] == 3_000 and len(set(long[0]["text"].split())) == 2
    assert [r["n_social"] for r in out if r["doc_id"] is None] == [1]


def test_running_sums_of_any_length(spark):
    for n in (0, 1, 63, 64, 65, 4_096, 4_097, 20_000):
        got = spark.range(1).select(spans.running_sums(F.expr(f"CASE WHEN {n} = 0 THEN array() ELSE transform(sequence(1, greatest({n}, 1)), x -> x % 7) END").cast("array<int>")).alias("s")).first()["s"]
        want, total = [], 0
        for i in range(1, n + 1):
            total += i % 7
            want.append(total)
        assert got == want


def test_places_of_a_hundred_thousand_matches(spark):
    n = 100_000
    text = "".join(f"\u00e9 token={i:08d}\n" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    docs.count()
    began = time.time()
    got = docs.select(spans.places(F.col("text"), secrets.ASSIGN, 0, 2, secrets.ASSIGN_LEAST).alias("p")).select(F.size("p").alias("n"), F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(n - 1)).alias("z")).first()
    assert time.time() - began < 60
    line = len("\u00e9 token=00000000\n")
    assert got["n"] == n and (got["a"]["start"], got["a"]["end"], got["a"]["value"]) == (2, line - 1, "00000000")
    assert (got["z"]["start"], got["z"]["end"], got["z"]["value"]) == ((n - 1) * line + 2, n * line - 1, f"{n - 1:08d}")


def test_licence_words_are_found_as_whole_words_only():
    words = licenses._telling()
    pattern = regex.compile(licenses._word_pattern(words))
    plain = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{M}\p{N}])")
    for word in words:
        for text in (word, word[:-1], word[1:], f"{word}s", f"x{word}", f"é{word}", f"({word})", f"a {word}, b", f"{word}́", f"{word}-{word}", f"{word[:2]} {word}x"):
            assert bool(pattern.search(text)) == bool(plain.search(text)), text


def test_a_text_without_a_needed_word_cannot_confirm_a_notice():
    needed = set(licenses._needed())
    for notices in licenses.NOTICES.values():
        for notice in notices:
            words = licenses._plain(notice)
            n = 3 if len(words) >= 4 else 2
            grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            assert sum(not needed & set(g) for g in grams) / len(grams) < licenses.CONFIRMED
