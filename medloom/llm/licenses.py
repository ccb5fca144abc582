"""Licence families of paragraphs by a trained n-gram classifier; DataFrame operations only.

A multinomial logistic regression with sparse weights is fitted on word n-grams of known notices,
parts of them, and a bounded sample of corpus paragraphs that resemble none. Its chances are
calibrated by one temperature on rows kept back. The feature set holds only n-grams of the notices,
so a paragraph with none of their telling words has no feature, is of the unknown class, and is not
scored. A prediction is confirmed by the share of a notice's word triples found in the paragraph.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, words_of

UNKNOWN = "unknown"
NEGATIVES = 4_000  # corpus paragraphs in the fit at most
CONFIRMED = 0.6
ACCEPT = 0.5
TEMPERATURES = tuple(0.25 * 1.25**i for i in range(16))

# fixed values: opening sentences and usual short notices of public licences
NOTICES = {
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL version 2 only.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced or transmitted without prior written permission.", "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
# fixed values: sentences about licences that grant none
OTHERS = (
    "He renewed his driver's license at the county office last week.", "The apache helicopter flew over the public park.", "A fishing license costs ten dollars for residents.",
    "The museum released a statement under pressure from the public.", "Students at MIT presented their work on software.", "The terms of the agreement were not made public.",
    "Version 3 of the program is now free for all users.", "The license plate was found under the bridge.", "She works in commercial software distribution.",
    "The general said that the foundation would be free of charge.", "You may use the source of the river without restriction.", "Permission was granted to the applicant on Monday.",
    "A modified version of the form is available from the office.", "The company is licensed to sell insurance.", "Please read the conditions before you use this service.",
)
# fixed values: words too common to be telling
STOP = frozenset("a an and any as at be by for from in is it its no not of on or part the this to with you your can may are that either all into has have at s v n".split())


def tokens(text: Column) -> Column:
    return F.filter(F.split(words_of(text), " "), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Runs of two or three words. Lambdas see their own arguments only, so words are made once."""
    later = [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(1, n)]
    joined = words
    for step in later:
        joined = F.zip_with(joined, step, lambda x, y: F.concat(x, F.lit(" "), y))  # null past the end
    return F.filter(joined, F.isnotnull)


def ngrams(words: Column) -> Column:
    return F.concat(words, _runs(words, 2), _runs(words, 3))


def _plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _telling() -> list[str]:
    return sorted({w for family in NOTICES.values() for notice in family for w in _plain(notice)} - STOP)


def _word_pattern(words: list[str]) -> str:
    """Pattern of any of ``words`` as a whole word, common beginnings written once; to be searched for, not cut out."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ends = "" in node
        ways = [c + written(below) for c, below in sorted(node.items()) if c]
        joined = ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})" if ways else ""
        return joined + "?" if ends and ways else joined

    return rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}]){written(root)}(?![\p{{L}}\p{{M}}\p{{N}}])"


def _needed() -> list[str]:
    """Words of which a text has at least one if it holds ``CONFIRMED`` of a notice.

    Of each notice the longest words, until the grams without any of them are too few to confirm it.
    """
    out = set()
    for notices in NOTICES.values():
        for notice in notices:
            words = _plain(notice)
            n = 3 if len(words) >= 4 else 2
            grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            chosen: set[str] = set()
            for word in sorted(set(words), key=lambda w: (-len(w), w)):
                if sum(not chosen & set(g) for g in grams) / len(grams) < CONFIRMED:
                    break
                chosen.add(word)
            out |= chosen
    return sorted(out)


def _constant(rows: list[tuple[str, ...]], names: tuple[str, ...], df: DataFrame) -> DataFrame:
    """A few fixed rows as expressions, so that no worker has to unpickle them."""
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names))) for r in rows]
    return df.sparkSession.range(1).select(F.inline(F.array(*structs)))


def _examples() -> list[tuple[str, str]]:
    out = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = _plain(notice)
            n = len(words)
            parts = {(0, n), (0, max(4, 2 * n // 3)), (n // 3, n), (0, max(4, n // 2)), (n // 4, max(n // 4 + 5, 3 * n // 4))}
            out += [(family, " ".join(words[i:j])) for i, j in sorted(parts) if set(words[i:j]) - STOP]
            out += [(family, f"copyright 2024 the authors {' '.join(words)}"), (family, f"{' '.join(words)} see the file for details")]
    return out


def _templates() -> Column:
    """Notices as one constant array of (family, grams): word triples, or pairs of short notices."""
    out = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = _plain(notice)
            n = 3 if len(words) >= 4 else 2
            grams = sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})
            out.append(F.struct(F.lit(family).alias("family"), F.array(*map(F.lit, grams)).alias("grams")))
    return F.array(*out)


def with_share(lines: DataFrame, family: Column | None = None) -> DataFrame:
    """Adds ``share``: the largest share of a notice's grams in ``line``, of any or one ``family``.

    A line keeps the grams that some notice has before single notices are compared.
    """
    held = lines if "known" in lines.columns else with_known(lines)
    meant = _templates() if family is None else F.filter(_templates(), lambda t: t["family"] == family)
    best = F.array_max(F.transform(meant, lambda t: F.size(F.array_intersect(t["grams"], "known")) / F.size(t["grams"])))
    return held.withColumn("share", F.coalesce(F.when(F.size("known") > 0, best), F.lit(0.0)))


def with_known(lines: DataFrame) -> DataFrame:
    """Adds ``known``: the word pairs and triples of ``line`` that some notice has."""
    known = F.array_distinct(F.flatten(F.transform(_templates(), lambda t: t["grams"])))
    held = lines.withColumn("given", tokens(F.col("line")))
    return held.withColumn("known", F.array_intersect(known, F.concat(_runs(F.col("given"), 2), _runs(F.col("given"), 3)))).drop("given")


def _wrapped(low: Column) -> Column:
    """Runs of several lines up to a line without words, where they hold enough of some notice.

    The words of a notice that is broken over lines stand in no single line. Marks of comments are
    no words, those made of letters are taken off. The share asked for is the one that confirms, so
    none that could be confirmed is left out; it is only counted in runs with a word that it needs.
    """
    known = F.array_distinct(F.flatten(F.transform(_templates(), lambda t: t["grams"])))
    best = lambda g: F.array_max(F.transform(_templates(), lambda t: F.size(F.array_intersect(t["grams"], g)) / F.size(t["grams"])))

    def share(block: Column) -> Column:
        held = F.transform(F.array(tokens(block)), lambda w: F.array_intersect(known, F.concat(_runs(w, 2), _runs(w, 3))))
        return F.coalesce(F.element_at(F.transform(held, lambda g: F.when(F.size(g) > 0, best(g))), 1), F.lit(0.0))

    blocks = F.split(F.regexp_replace(low, "\r\n?", "\n"), r"\n[^\p{L}\p{M}\p{N}]*\n")
    needed = F.lit(_word_pattern(_needed()))
    several = F.filter(blocks, lambda b: b.contains("\n") & F.regexp_like(b, needed))
    bare = F.transform(several, lambda b: F.regexp_replace(b, r"(?m)^[^\p{L}\p{M}\p{N}\n]*(?:rem|dnl|c)(?=[ \t]|$)", " "))
    return F.filter(bare, lambda b: share(b) >= CONFIRMED)


def fit(lines: DataFrame, negatives: int = NEGATIVES):
    """Fitted stages, family names in label order, and the temperature, from notices and ``lines``.

    ``lines`` (line) are distinct corpus paragraphs; at most ``negatives`` of those that share less
    than a fifth of any notice join the fit as unknown, picked by hash.
    """
    own = with_share(lines).filter("share < 0.2").select("line").orderBy(F.xxhash64("line"), "line").limit(negatives).select(F.lit(UNKNOWN).alias("family"), "line")
    fixed = _constant([*_examples(), *((UNKNOWN, s) for s in OTHERS)], ("family", "line"), lines)
    rows = cut(fixed.unionByName(own).withColumn("words", ngrams(tokens(F.col("line")))).coalesce(1))
    back = F.pmod(F.xxhash64("line"), F.lit(5)) == 0  # a fifth is kept back for the temperature
    named = rows.filter(F.col("family") != UNKNOWN)
    vocabulary = CountVectorizer(inputCol="words", outputCol="features", binary=True, minDF=1.0, vocabSize=20_000).fit(named)
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    ready = Pipeline(stages=[vocabulary, index]).fit(rows)
    model = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.5, family="multinomial").fit(ready.transform(rows.filter(~back)))
    raw = model.transform(ready.transform(rows.filter(back))).select("label", vector_to_array("rawPrediction").alias("raw"))
    tried = raw.select("label", "raw", F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("t"))
    loss = F.log(F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp(F.least(x / F.col("t"), F.lit(500.0))))) - F.element_at("raw", F.col("label").cast("int") + 1) / F.col("t")
    losses = tried.groupBy("t").agg(F.sum(loss).alias("loss")).collect()  # one row per temperature
    best = min(losses, key=lambda r: (r["loss"], r["t"]))["t"] if losses else 1.0
    return vocabulary, model, list(index.labels), best


def classify(lines: DataFrame, fitted) -> DataFrame:
    """line, family, probability, share, confirmed for each of ``lines``."""
    vocabulary, model, names, temperature = fitted
    given = vocabulary.transform(lines.withColumn("words", ngrams(tokens(F.col("line")))))
    extra = [c for c in lines.columns if c != "line"]
    raw = cut(model.transform(given).select("line", *extra, vector_to_array("rawPrediction").alias("raw")))
    top = F.array_max("raw")
    scaled = raw.select("line", *extra, F.transform("raw", lambda x: F.exp((x - top) / F.lit(temperature))).alias("e"))
    chance = scaled.select("line", *extra, F.array_position("e", F.array_max("e")).cast("int").alias("at"), (F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda s, x: s + x)).alias("probability"))
    family = F.element_at(F.array(*map(F.lit, names)), F.col("at"))
    named = chance.select("line", *extra, F.when(F.col("probability") >= ACCEPT, family).otherwise(UNKNOWN).alias("family"), "probability")
    return with_share(named, F.col("family")).withColumn("confirmed", F.col("share") >= CONFIRMED).drop("known")


def license_scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """doc_id, family, probability, confirmed, families, n_paragraphs: one row per row.

    A paragraph is a line, or the lines up to one without words. ``n_paragraphs`` counts the lines
    with a telling word, ``families`` lists the confirmed families of lines and runs in order, ``family`` is that of the most probable confirmed paragraph, or
    unknown. Null and empty texts have no paragraphs. Repeated rows repeat. Equal paragraphs are
    scored once, however many documents hold them.
    """
    telling = _word_pattern(_telling())
    low = F.lower(text_of())
    held = F.filter(F.split(low, "[\n\r]+"), lambda line: F.regexp_like(line, F.lit(telling)))
    none = F.array().cast("array<string>")
    told = F.regexp_like(low, F.lit(telling))
    rows = docs.select(F.col("doc_id"), F.when(told, held).otherwise(none).alias("lines"), F.when(told, _wrapped(low)).otherwise(none).alias("runs"))
    rows = cut(rows.withColumn("row", F.xxhash64("doc_id", "lines", "runs")))
    each = rows.filter(F.size("lines") > 0).select("row", F.explode(F.concat("lines", "runs")).alias("line"))
    lines = cut(with_known(each.select("line").distinct()))
    scored = classify(lines, fit(lines, negatives)).filter("confirmed")
    hits = each.distinct().join(scored, "line")
    per_row = hits.groupBy("row").agg(
        F.max_by("family", F.struct("probability", "family")).alias("best"), F.max("probability").alias("probability"), F.array_sort(F.collect_set("family")).alias("families"))
    out = rows.join(per_row, "row", "left")
    return out.select(
        "doc_id", F.coalesce("best", F.lit(UNKNOWN)).alias("family"), F.round("probability", 6).alias("probability"), F.col("best").isNotNull().alias("confirmed"),
        F.coalesce("families", none).alias("families"), F.size("lines").cast("long").alias("n_paragraphs"))
