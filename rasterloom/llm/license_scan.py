"""Licence scans, in DataFrame operations only.

A text's segments (the whole text, its paragraphs, lines and sentences) are normalised: A-Z lower-cased,
each run of characters other than a-z and 0-9 one space. A segment is compared with a template by the Dice
coefficient of their sets of word bigrams, 2 |A and B| / (|A| + |B|). A coefficient of t needs
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so templates of other sizes are not compared.

Texts with no word that all matches need are done at once. The segments' bigrams of the others are joined by equality to
the bigrams of the templates of fitting size, and counted for each segment and template.

Templates are the short forms and notices below and the whole licence texts in the folder ``licenses``, each
as its steward publishes it. Licences with nearly one text (BSD-2-Clause and BSD-3-Clause) can both be found; the
better one is first.

Edge cases: a null or empty text, and one without a segment of two words, matches nothing. Equal
coefficients go to the licence that sorts first. Texts of any length are read whole. An empty
table has an empty result. Repeated rows, null ids and extra columns pass through; one named licenses is replaced.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

THRESHOLD = 0.8
#: Bigrams from which on a template is looked for by size alone; shorter ones also by telling words.
LONG = 60

#: Short forms and notices of public licences, as they are written in files.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY 4.0.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-ND-4.0": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-ND 4.0.",
    ],
    "CC-BY-NC-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-NC-ND-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "This work is licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "CC-BY-3.0": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "Licensed under CC BY 3.0."],
    "CC-BY-SA-3.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Licensed under CC BY-SA 3.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, version 1.2."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_bigrams(text: str) -> list[str]:
    """The sorted set of word bigrams of a normalised text."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


@lru_cache(maxsize=1)
def bodies() -> dict[str, str]:
    """Licence -> its whole text."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def templates() -> list[tuple[str, list[str]]]:
    """(licence, sorted bigrams) of all templates; no two are equal."""
    known = [(name, template_bigrams(t)) for name, texts in TEMPLATES.items() for t in texts]
    return known + [x for x in ((name, template_bigrams(t)) for name, t in bodies().items()) if x not in known]


def normalised(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def segments(text: Column) -> Column:
    """A text's segments as they are, some more than once."""
    paragraphs = F.split(text, r"\n[ \t]*\n", -1)
    lines = F.split(text, "\n", -1)
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n\n"), "\n\n", -1)
    return F.concat(F.array(text), paragraphs, lines, sentences)


def bigrams(segment: Column) -> Column:
    words = F.split(segment, " ", -1)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def needed(grams: list[str], threshold: float) -> int:
    """Of how many bigrams of a template, whichever, a segment at the threshold has at least one: it shares
    |B| t / (2 - t) of them or more, so it cannot miss all of more than the rest."""
    return len(grams) - max(1, math.ceil(len(grams) * threshold / (2 - threshold))) + 1


def telling_words(known: list[list[str]], threshold: float) -> list[str]:
    """A few words of which every segment at the threshold of some template has one: words are taken by how
    many bigrams they are in, until of each template as many bigrams hold one as are needed()."""
    missing = [(set(g), needed(g, threshold)) for g in known]
    chosen: list[str] = []
    while missing:
        counts = Counter(w for grams, _ in missing for g in grams for w in set(g.split(" ")))
        word = max(counts, key=lambda w: (len(w) > 5, counts[w] * len(w), w))  # short words are in every text
        chosen.append(word)
        left = []
        for grams, n in missing:
            rest = {g for g in grams if word not in g.split(" ")}
            if n - (len(grams) - len(rest)) > 0:
                left.append((rest, n - (len(grams) - len(rest))))
        missing = left
    return chosen


def scanned(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, known: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """df with licenses added: an array of struct(license, dice, segment), one for each licence found,
    the best segment of each, the largest coefficient first."""
    known = templates() if known is None else known
    none = F.array().cast("array<struct<license:string,dice:double,segment:string>>")
    if not known:
        return df.withColumn("licenses", none)
    share = threshold / (2 - threshold)
    least = lambda sizes: min(sizes, default=0) * share
    short, long = [g for _, g in known if len(g) < LONG], [g for _, g in known if len(g) >= LONG]
    words = telling_words(short, threshold)
    # Short words are in many others, so they have to stand alone.
    alone = "|".join(w for w in words if len(w) < 6)
    inside = [w for w in words if len(w) >= 6]
    apart = lambda c: F.rlike(c, F.lit(f"(?<![a-z0-9])(?:{alone})(?![a-z0-9])")) if alone else F.lit(False)
    telling = lambda c: reduce(operator.or_, (F.contains(c, F.lit(w)) for w in inside), apart(c))
    gaps = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" ")))
    roomy = lambda s: F.length(s) >= 2 * least(map(len, long)) if long else F.lit(False)  # noqa: E731  a word and a space at least
    body = F.col(text)
    # Short templates need one of a few words, long ones room and a word of theirs. Texts without go no further.
    needs = telling_words(long, threshold)
    likely = F.exists(F.split(normalised(body), " ", -1), lambda w: w.isin(needs)) if needs else F.lit(False)
    long_too = F.coalesce(roomy(body) & likely, F.lit(False))
    gate = F.coalesce(telling(F.lower(body)), F.lit(False)) | long_too
    plain = df.where(~gate).withColumn("licenses", none)

    rows = df.where(gate).select(F.struct("*").alias("__row"), long_too.alias("__long")).withColumn("__key", F.monotonically_increasing_id())
    rows = staged(rows, "license-rows")
    raw = F.filter(segments(F.col("__row").getField(text)), lambda s: (F.col("__long") & roomy(s)) | telling(F.lower(s)))
    parts = rows.select("__key", "__long", F.explode(F.array_distinct(F.transform(raw, normalised))).alias("s"))
    # Words bound the size of a set of bigrams from above only.
    enough = telling(F.col("s")) & (gaps(F.col("s")) >= least(map(len, short)))
    parts = parts.where(enough | (F.col("__long") & (gaps(F.col("s")) >= least(map(len, long)))) if long else enough)
    sets = parts.withColumn("g", bigrams(F.col("s"))).withColumn("n", F.size("g"))
    entry = lambda k, name, grams: F.struct(F.lit(k).alias("k"), F.lit(name).alias("license"), F.lit(len(grams)).alias("size"), F.lit("|".join(grams)).alias("grams"))
    index = df.sparkSession.range(1).select(F.inline(F.array(*(entry(k, *x) for k, x in enumerate(known)))))
    index = F.broadcast(index.select("k", "license", "size", F.explode(F.split("grams", r"\|", -1)).alias("gram")))  # as large as the templates
    met = sets.select("__key", "s", "n", F.explode("g").alias("gram")).join(index, "gram").where(F.col("n").between(F.col("size") * share, F.col("size") / share))
    common = met.groupBy("__key", "s", "n", "k", "license", "size").agg(F.count(F.lit(1)).alias("common"))
    dice = F.round(2.0 * F.col("common") / (F.col("n") + F.col("size")), 6)
    best = common.withColumn("dice", dice).where(F.col("dice") >= threshold).groupBy("__key", "license").agg(F.min(F.struct((-F.col("dice")).alias("d"), "s")).alias("b"))
    found = best.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("b.d", "license", "b.s"))).alias("found"))  # one for each licence at most
    licenses = F.transform("found", lambda x: F.struct(x["license"].alias("license"), (-x["d"]).alias("dice"), x["s"].alias("segment")))
    judged = rows.join(found, "__key", "left")
    own = [(F.coalesce(licenses, none) if c == "licenses" else F.col("__row").getField(c)).alias(c) for c in plain.columns]
    return plain.unionByName(judged.select(*own))
