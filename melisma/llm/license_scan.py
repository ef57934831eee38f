"""License notices by MinHash bands over overlapping windows. DataFrame functions only.

A text is its words (letters and digits, lower case) and their shingles of SHINGLE words at every position; for templates
of fewer words, also of so many words. Windows of WINDOW shingles, each starting half a window after the last, get BANDS
MinHash values; a value that a window of a template has too retrieves the template. A template is then verified exactly:
the share of its shingles that the text holds must reach PCT percent.

Bands of one value each make retrieval near certain: a shingle lies in two windows, so that even a notice of a single
shingle, whose windows share a quarter with it, is missed with a chance of 0.75 ** (2 * BANDS), about one in a million; a
notice of n shingles has about n / 2 more windows to be found by.

Only texts in which one of the templates' anchors stands are hashed at all. Anchors are a template's longest words, so
many that the shingles without any of them fall short of PCT percent: a text without anchors can hold no template.

Edge cases: null and empty texts hold nothing; rows with the same id and text count once; an empty table gives no rows.
Other columns are ignored, whatever their names. The templates are a parameter, of a bounded number and broadcast; one
without words is never found.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
WINDOW = 4
BANDS = 24
PCT = 80
_SLOT_BITS = 16

#: Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles(text: Column, sizes: list[int]) -> Column:
    """Hashes of a text's shingles of each size, in order, size by size."""
    none = F.array().cast("array<bigint>")

    def of(w: Column, k: int) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + j if j else i) for j in range(k)])
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), at)).otherwise(none)

    return _let(F.transform(_words(text), lambda w: F.xxhash64(w)), lambda w: F.concat(none, *[of(w, k) for k in sizes]))


def anchors(words: list[str], pct: int) -> set[str]:
    """The longest words of a template, so many that a text which holds pct percent of its shingles has one of them."""
    k = min(len(words), SHINGLE)
    open_ = [set(g) for g in {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}]
    least, found = -(-pct * len(open_) // 100), set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(open_) < max(least, 1):
            break
        found.add(w)
        open_ = [s for s in open_ if w not in s]
    return found


def band_values(hashes: Column, step: int, first: int, keep=None) -> Column:
    """The MinHash values of all windows of the array of hashes; first and step place the windows."""

    def one(k: int) -> Column:
        def mins(p: Column) -> Column:
            starts = F.sequence(F.lit(first), F.greatest(F.size(p) - 1, F.lit(first)), F.lit(step))
            # only windows that may start before the text need the bound
            at = lambda i: F.get(p, i) if first >= 0 else F.when(i >= 0, F.get(p, F.greatest(i, F.lit(0))))
            got = F.transform(starts, lambda i: F.least(*[at(i + j if j else i) for j in range(WINDOW)]))
            return F.filter(got, keep) if keep is not None else F.filter(got, lambda v: v.isNotNull())

        return _let(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(k))), mins)

    return F.concat(*[one(k) for k in range(BANDS)])


def template_words(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[str]]:
    """The words of the templates that have any."""
    if not templates:
        return {}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()]))
    return {r.license: r.words for r in spark.range(1).select(rows.alias("t")).select("t.license", _words(F.col("t.text")).alias("words")).collect() if r.words}


def template_table(spark: SparkSession, words: dict[str, list[str]]) -> DataFrame:
    """license, grams (distinct shingles), bands (distinct MinHash values of its windows at every offset)."""
    parts = []
    for size in sorted({min(len(w), SHINGLE) for w in words.values()}):
        mine = [F.struct(F.lit(k).alias("license"), F.lit(" ".join(w)).alias("text")) for k, w in words.items() if min(len(w), SHINGLE) == size]
        parts.append(spark.range(1).select(F.explode(F.array(*mine)).alias("t")).select("t.license", shingles(F.col("t.text"), [size]).alias("h")))
    base = functools.reduce(DataFrame.unionByName, parts)
    return base.select("license", F.array_distinct("h").alias("grams"), F.array_distinct(band_values(F.col("h"), 1, 1 - WINDOW)).alias("bands"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", pct: int = PCT) -> DataFrame:
    """doc_id, mark (a hash of the text), license, n_template, n_found: the templates that a text holds."""
    spark = docs.sparkSession
    own = template_words(spark, TEMPLATES if templates is None else templates)
    if not own:
        return spark.createDataFrame([], "doc_id long, mark long, license string, n_template long, n_found long")
    known = template_table(spark, own)
    mask = (1 << _SLOT_BITS) - 1
    table = bytearray(b"0" * (mask + 1))
    for r in known.select(F.explode("bands").alias("b")).distinct().collect():  # as many as the templates have
        table[r.b & mask] = table[(r.b >> 20) & mask] = 49
    slots = F.lit(bytes(table))
    marked = lambda v, s: F.substring(slots, F.shiftrightunsigned(v, s).bitwiseAND(F.lit(mask)).cast("int") + 1, 1) == F.lit(b"1")
    keep = lambda v: v.isNotNull() & marked(v, 0) & marked(v, 20)
    text = C.col(text_col).cast("string")
    low = F.lower(text)
    some = functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in sorted(set().union(*[anchors(w, pct) for w in own.values()]))])
    sizes = sorted({min(len(w), SHINGLE) for w in own.values()})
    # the generator keeps what it makes from being worked out twice
    hashed = docs.where(some).select(C.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.explode(F.array(shingles(text, sizes))).alias("h"))
    hits = hashed.select("doc_id", "mark", "h", F.explode(F.array(F.array_distinct(band_values(F.col("h"), WINDOW // 2, 0, keep)))).alias("bands")).where(F.size("bands") > 0)
    by_band = known.select("license", "grams", F.explode("bands").alias("band"))
    found = hits.select("doc_id", "mark", "h", F.explode("bands").alias("band")).join(F.broadcast(by_band), "band")
    held = F.size(F.array_intersect("grams", "h"))
    out = found.select("doc_id", "mark", "license", F.size("grams").cast("long").alias("n_template"), held.cast("long").alias("n_found"))
    return out.where(100 * F.col("n_found") >= pct * F.col("n_template")).distinct()


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents")).select("doc_id", "license", "n_template", "n_found")


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    grams = "SELECT DISTINCT id, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM"
    return f"""
WITH lic(id, text) AS (VALUES {values}),
tw AS (SELECT id, ws, least(len(ws), {SHINGLE}) AS k FROM (SELECT id, {words} AS ws FROM lic)),
dw AS (SELECT doc_id AS id, {words} AS ws FROM documents WHERE text IS NOT NULL),
tg AS ({grams} tw)),
dg AS ({grams} (SELECT id, ws, k FROM dw, (SELECT DISTINCT k FROM tw)))),
n AS (SELECT id, count(*) AS n FROM tg GROUP BY id),
o AS (SELECT dg.id AS doc_id, tg.id AS license, count(*) AS k FROM dg JOIN tg USING (g) GROUP BY 1, 2)
SELECT o.doc_id, o.license, n.n AS n_template, o.k AS n_found FROM o JOIN n ON n.id = o.license WHERE 100 * o.k >= {PCT} * n.n
"""


SQL = _sql()
