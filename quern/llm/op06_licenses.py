"""License scans with DataFrame functions only.

Texts become words of a-z and 0-9.  Overlapping windows of words, in a few sizes
that fit the templates, get MinHash values of their 5-word shingles, one row a
band; an equi-join with the bands of the templates retrieves candidates, and the
share of the template's shingles that the window holds decides.

Bands.  A window of size class L has at most 1.25 L words, starts every L / 4
words, and so some window holds any passage of a template of up to L words whole.
A passage with containment 0.8 then has a Jaccard similarity s of at least about
0.8 n / (1.25 L + 0.2 n) with n > 0.75 L template words, over 0.4.  With b bands
of one row the chance to miss it is (1 - s) ** b: below 5e-8 for b = 32.

Before that, a test that can lose nothing: anchors of a template are words such
that less than 0.8 of its shingles avoid all of them, so a passage with
containment 0.8 holds an anchor.  Only texts and windows with an anchor go on.

The templates are a parameter, sent to all tasks as literals of the plan.  A null
or empty text matches nothing; so does a template without words.  Rows that
repeat a doc_id, and rows with a null one, give one row for each license found in
any of them; of windows that match alike the first counts.  Other columns don't
matter, whatever their names.  Nothing is
grouped but matches, so common texts make no hot task beyond their matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

K, BANDS, LEAST = 5, 32, 0.8
CLASSES = (5, 7, 9, 12, 16, 21, 28, 37, 50, 67, 90, 120, 160, 215, 290, 390, 520)

# Short forms of common license notices, as they are used in public projects.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def plain_words(text: str) -> list[str]:
    """What ``_words`` makes of a template."""
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def anchors_of(text: str, k: int = K, least: float = LEAST) -> list[str]:
    """Words without which less than ``least`` of the shingles of the text are left; long and rare
    ones are taken first."""
    words = plain_words(text)
    n = max(1, len(words) - k + 1)
    spans = [range(i, min(i + k, len(words))) for i in range(n)]
    left, out = set(range(n)), []
    by = {w: {i for i, s in enumerate(spans) if any(words[j] == w for j in s)} for w in words}
    rank = lambda w: (len(w) < 5, -len(by[w] & left), -len(w), w)
    while len(left) >= least * n:
        out.append(min((w for w in by if by[w] & left), key=rank))
        left -= by[out[-1]]
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _shingles(words: Column, k: int = K) -> Column:
    """Distinct hashes of k-word shingles; fewer words make one."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, k), " "))))


def _minhash(shingles: Column, bands: int) -> Column:
    """One minimum per band; the band's number makes another order of the same hashes."""

    def least(b: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(b))))

    return F.array(*map(least, range(bands)))


def _starts(words: Column, size: int) -> Column:
    """Windows of one size class as (size, start, wide)."""
    step = max(1, size // 4)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)) + (step - 1), F.lit(step)), lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), F.lit(size + step).alias("wide")))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: passing through a generator keeps the optimiser
    from repeating the expression wherever, and inside whichever lambda, it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", text: str = "text", bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """(doc_id, license, containment, first_word, words, windows): for each document and license
    the best window, by containment, then by place, and the number of windows that match."""
    spark = docs.sparkSession
    schema = "doc_id long, license string, containment double, first_word long, words long, windows long"
    known = [(n, name, t, len(plain_words(t))) for n, (name, t) in enumerate(templates) if plain_words(t)]
    if not known:
        return spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    sizes = {n: next((c for c in CLASSES if c >= size), size) for n, _, _, size in known}
    anchors = sorted({a for _, _, t, _ in known for a in anchors_of(t, least=least)})
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("template"), F.lit(name).alias("license"), F.lit(t).alias("t"), F.lit(sizes[n]).alias("size")) for n, name, t, _ in known])).alias("x")).select("x.*")
    table = _held(_held(table, "tw", _words(F.col("t"))), "own", _shingles(F.col("tw"))).drop("t", "tw")
    table = table.select("template", "license", "size", "own", F.posexplode(_minhash(F.col("own"), bands)).alias("band", "value"))

    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.col(text)).alias("t"))
    any_anchor = F.lit(False)
    for a in anchors:
        any_anchor = any_anchor | F.contains(F.col("t"), F.lit(a))
    words = _held(docs.where(any_anchor), "w", _words(F.col("t"))).drop("t").where(F.size("w") > 0)
    starts = F.concat(*[_starts(F.col("w"), c) for c in sorted(set(sizes.values()))])
    # places of anchors first: a window without one is never made
    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    placed = _held(words, "at", at).where(F.size("at") > 0)
    windows = placed.select("doc_id", "w", F.explode(F.filter(starts, lambda s: F.exists("at", lambda i: (i >= s["start"]) & (i < s["start"] + s["wide"])))).alias("s"))
    windows = windows.select("doc_id", "s.size", "s.start", F.explode(F.array(F.slice("w", F.col("s.start") + 1, F.col("s.wide")))).alias("own_words"))
    windows = _held(windows.withColumn("words", F.size("own_words")), "shingles", _shingles(F.col("own_words"))).drop("own_words")
    banded = windows.select("doc_id", "size", "start", "words", "shingles", F.posexplode(_minhash(F.col("shingles"), bands)).alias("band", "value"))
    # the templates are a short list of literals
    found = banded.join(F.broadcast(table), ["size", "band", "value"])
    # a window meets a template in several bands; the first equal band stands for all
    held = found.select("doc_id", "template", "license", "start", "words", (F.size(F.array_intersect("shingles", "own")) / F.size("own")).alias("containment")).where(F.col("containment") >= least - 1e-9)
    best = F.max_by(F.struct("start", "words"), F.struct("containment", -F.col("words"), -F.col("start")))
    return (
        held.groupBy("doc_id", "license")
        .agg(F.max("containment").alias("containment"), best.alias("b"), F.count_distinct("template", "start", "words").alias("windows"))
        .select("doc_id", "license", "containment", F.col("b.start").cast("long").alias("first_word"), F.col("b.words").cast("long").alias("words"), "windows")
    )


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
