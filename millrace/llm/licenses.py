"""License scan: the distinct shingles of each text are looked up among those of all templates and counted by template.

Texts become words of a-z and 0-9, and shingles of five words (a shorter template is one shingle of its length). A row's
shingles meet the sent table of template shingles one by one, so containment is exact and no case depends on chance, and
only shingles that are met are dealt out. All of it is DataFrame functions.

Before that, texts without any anchor word can't hold a shingle of any template and are left out: the anchors are words
such that every shingle of every template has one of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5

#: Notices that are looked for unless others are given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Rights-reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_shingles(text: str) -> set[tuple[str, ...]]:
    w = template_words(text)
    n = min(SHINGLE, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every shingle has one; long words first, since they are rarer."""
    open_ = {s for t in templates.values() for s in template_shingles(t)}
    out = []
    while open_:
        word = max({w for s in open_ for w in s}, key=lambda w: (min(len(w), 8) * (1 + 0.2 * sum(w in s for s in open_)), w))
        out.append(word)
        open_ = {s for s in open_ if word not in s}
    return out


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingles(text: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    many = lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), many)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, license, containment: a row for each template of which the whole text holds at least
    this share of the distinct shingles. Null and empty texts hold none; a repeated row is reported as often as it occurs;
    an empty table or no templates give no rows. Templates are a parameter, so their table is small enough to send."""
    spark = docs.sparkSession
    templates = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if template_words(t)}
    empty = spark.createDataFrame([], "doc_id long, license string, containment double")
    if not templates:
        return empty
    any_anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(anchors(templates))) + ")(?![a-z0-9])"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(any_anchor))
    rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("times")).withColumn("row", F.struct("doc_id", F.xxhash64("text"), F.crc32(F.col("text").cast("binary"))))
    out = empty
    for n in sorted({min(SHINGLE, len(template_words(t))) for t in templates.values()}):
        some = [(k, t) for k, t in templates.items() if min(SHINGLE, len(template_words(t))) == n]
        known = spark.createDataFrame(some, "license string, words string").withColumn("t", F.array_distinct(_shingles(F.col("words"), n)))
        keys = known.select("license", F.size("t").alias("size"), F.explode("t").alias("key"))
        here = rows.select("row", "times", F.explode(F.array_distinct(_shingles(F.col("text"), n))).alias("key"))
        held = here.join(F.broadcast(keys), "key").groupBy("row", "license", "size", "times").agg(F.count("*").alias("held"))
        whole = held.select(F.col("row.doc_id").alias("doc_id"), "license", (F.col("held") / F.col("size")).alias("containment"), "times").where(F.col("containment") >= containment)
        out = out.unionByName(whole.select("doc_id", "license", "containment", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("i")).drop("i"))
    return out


def oracle(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    values = ", ".join(f"('{k}', '{' '.join(s)}')" for k, t in (templates or TEMPLATES).items() for s in sorted(template_shingles(t)))
    return f"""WITH t(license, shingle) AS (VALUES {values}), n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, license, count(*) / CAST(any_value(n.n) AS DOUBLE) AS containment FROM d JOIN t ON contains(d.w, ' ' || t.shingle || ' ') JOIN n USING (license) GROUP BY r, doc_id, license HAVING count(*) / CAST(any_value(n.n) AS DOUBLE) >= {containment}"""
