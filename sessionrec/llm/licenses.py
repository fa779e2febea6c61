"""License scans: MinHash bands over text windows, then exact containment (built-in functions only)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import SHINGLE, SIMILARITY, Scratch, paired_hashes, read_documents, text_or_empty

# Notices and whole texts of well-known licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "gpl-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense-opening": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
#: MinHash values of a window. Bands are of one row each, so a window that holds the least part of
#: a template asked for is missed with a chance of (1 - similarity)**BANDS; see retrieval_chance().
BANDS = 24


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def template_shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def window(words: int) -> tuple[int, int]:
    """(length, step) of the windows for a template of so many words, in words.

    Lengths go by four steps to a doubling. Windows start at the multiples of step, and are longer
    by step - 1 than the templates that they are for: so whatever stretch of a text is as long as
    the template lies in one of them whole.
    """
    size = SHINGLE
    while size < words:
        size = max(size + 1, 2 ** (math.floor(math.log2(size)) - 2) + size)
    step = max(1, size // 8)
    return size + step - 1, step


def least_hits(shingles: int) -> int:
    return math.ceil(shingles * SIMILARITY[0] / SIMILARITY[1])


def prepared(templates: dict[str, str]) -> list[tuple[str, int, int, list[str]]]:
    """(name, window length, window step, shingles) of each template; any length from SHINGLE words on."""
    out = []
    for name, text in templates.items():
        words = template_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"{name}: a template has {SHINGLE} words at least")
        out.append((name, *window(len(words)), sorted(template_shingles(words))))
    return out


def retrieval_chance(templates: dict[str, str] = TEMPLATES) -> float:
    """The least chance, over all templates, that a window with just the part asked for is retrieved."""
    least = 1.0
    for _, length, _, found in prepared(templates):
        shared = least_hits(len(found))
        similarity = shared / (length - SHINGLE + 1 + len(found) - shared)
        least = min(least, 1 - (1 - similarity) ** BANDS)
    return least


def minhashes(shingles: Column) -> Column:
    """(band, least hash) for each of BANDS hash functions."""
    return F.array(*[F.struct(F.lit(k).alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(k), s))).alias("least")) for k in range(BANDS)])


def clean_words(text: Column) -> Column:
    """Words of letters a-z and digits, A-Z in lower case; anything else separates."""
    lower = F.translate(text_or_empty(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, "[^a-z0-9]+"), "")


def with_shingle_hashes(rows: DataFrame) -> DataFrame:
    """Adds hashes: one for each run of five of the words, made of runs of 1, 2 and 4, a column each so that none is made twice."""
    rows = rows.withColumn("_one", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_two", paired_hashes(F.col("_one"), F.col("_one"), 1))
    rows = rows.withColumn("_four", paired_hashes(F.col("_two"), F.col("_two"), 2))
    return rows.withColumn("hashes", paired_hashes(F.col("_four"), F.col("_one"), 4)).drop("_one", "_two", "_four")


def window_starts(length: int, step: int, least: int) -> Column:
    """The windows of one length that hold a template shingle: those that start at a multiple of step and hold a place of `places` whole."""
    first = lambda at: F.greatest(F.ceil((at + (SHINGLE - length)) / step).cast("int"), F.lit(0))
    numbers = F.array_distinct(F.flatten(F.transform("places", lambda at: F.sequence(first(at), F.floor(at / step).cast("int")))))
    return F.transform(numbers, lambda k: F.struct(F.lit(length).alias("length"), F.lit(least).alias("least"), (k * step).alias("start")))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, start_word: a row for each document and template with at least
    SIMILARITY of the template's shingles in one window.

    Every text is cut into windows of each template's length that overlap by seven eighths (see
    window()). A window with fewer shingles of templates than any template of its length asks for
    can't match, whatever its other words, so those go first, by a set of hashes. Bands of MinHash
    values of the others retrieve templates, whose containment is then taken exactly, by words.
    All that is broadcast is as large as the given templates, whatever the input.

    Null, empty and short texts have no match; of windows equal in containment the earliest counts;
    rows of one doc_id count together, null like any other; a very long text costs by its length,
    and its windows with template shingles are dealt over the tasks; other columns are not used;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    known = prepared(templates)
    table = spark.createDataFrame(known, "license string, length int, step int, template array<string>")
    by_shingle = with_shingle_hashes(table.select("license", F.explode("template").alias("shingle")).select("license", F.split("shingle", " ").alias("words")))
    table = table.join(by_shingle.groupBy("license").agg(F.flatten(F.collect_list("hashes")).alias("hashes")), "license")
    bands = table.select("license", "length", "template", F.explode(minhashes(F.col("hashes"))).alias("m")).select("license", "length", "template", "m.band", "m.least")
    bands = bands.groupBy("length", "band", "least").agg(F.collect_list(F.struct("license", "template")).alias("hits"))
    sizes = {}
    for _, length, step, found in known:
        sizes[length, step] = min(sizes.get((length, step), 2**31), least_hits(len(found)))
    every = table.agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("_known"))  # one row, of the templates' size
    found = docs.select("doc_id", clean_words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    found = with_shingle_hashes(found).crossJoin(F.broadcast(every)).where(F.arrays_overlap("hashes", "_known"))
    found = scratch.write(found.withColumn("_known", F.array_intersect("hashes", "_known")), "with_template_shingles")
    places = F.transform("hashes", lambda h, at: F.when(F.array_contains("_known", h), at))
    found = found.withColumn("places", F.filter(places, lambda at: at.isNotNull()))
    starts = F.flatten(F.array(*[window_starts(length, step, least) for (length, step), least in sorted(sizes.items())]))
    here = lambda column, count: F.slice(column, F.col("o.start") + 1, count)
    windows = found.withColumn("o", F.explode(starts)).withColumn("shingles", F.array_distinct(here("hashes", F.col("o.length") - (SHINGLE - 1))))
    windows = windows.where(F.size(F.array_intersect("shingles", "_known")) >= F.col("o.least"))
    windows = scratch.write(windows.select("doc_id", F.col("o.length").alias("w"), F.col("o.start").alias("start"), "shingles", here("words", F.col("o.length")).alias("part")), "windows")
    parts = max(1, -(-windows.count() // 5_000))
    banded = windows.repartition(parts).withColumn("m", F.explode(minhashes(F.col("shingles")))).select("doc_id", "w", "start", "part", "m.band", "m.least")
    hits = banded.join(F.broadcast(bands.select("length", F.col("band").alias("b"), F.col("least").alias("l"), "hits")), (F.col("w") == F.col("length")) & (F.col("band") == F.col("b")) & (F.col("least") == F.col("l")))
    hits = hits.select("doc_id", "w", "start", "part", F.explode("hits").alias("t")).dropDuplicates(["doc_id", "w", "start", "part", "t"])
    shingles = F.transform(F.sequence(F.lit(1), F.size("part") - SHINGLE + 1), lambda i: F.array_join(F.slice("part", i, SHINGLE), " "))
    part = F.size(F.array_intersect(shingles, F.col("t.template"))) / F.size("t.template")
    scored = hits.select("doc_id", F.col("t.license").alias("license"), "start", part.alias("containment")).where(F.col("containment") * SIMILARITY[1] >= SIMILARITY[0])
    best = scored.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", F.round("best.containment", 6).alias("containment"), (-F.col("best.back")).cast("int").alias("start_word"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir))


def _sql() -> str:
    """Every window of every text, without MinHash: windows by the template shingles in them."""
    known = ", ".join(f"('{name}', {length}, {step}, [{', '.join(repr(s) for s in found)}])" for name, length, step, found in prepared(TEMPLATES))
    return rf"""
with t as (select *, len(template) as size from (values {known}) v(license, length, step, template)
), ts as (
  select license, length, step, size, unnest(template) as shingle from t
), d as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') as ws
  from documents
), p as (
  select rid, doc_id, ws, unnest(range(0, len(ws) - 4)) as i from d where len(ws) >= 5
), s as (
  select rid, doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') as shingle from p
), h as (
  select rid, doc_id, i, license, length, step, size, shingle from s join ts using (shingle)
), w as (
  select rid, doc_id, license, size, shingle, unnest(range(greatest(0, (i + 5 - length + step - 1) // step), i // step + 1)) * step as start from h
), c as (
  select doc_id, license, start, count(distinct shingle)::double / size as containment from w group by rid, doc_id, license, size, start
)
select doc_id, license, round(max(containment), 6) as containment, arg_min(start, (-containment, start))::int as start_word
from c where containment * 100 >= 75 group by doc_id, license
"""


QUERIES = {"op9_license_scan": op9_license_scan}
SQL = {"op9_license_scan": _sql()}
