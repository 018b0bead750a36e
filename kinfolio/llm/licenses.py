"""License scans: MinHash bands over text windows, then exact containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Notices and terms by which licenses are known.
TEMPLATES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc/terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit/notice": "Released under the MIT License.",
    "mit/terms": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "reserved/notice": "All rights reserved.",
    "unlicense/notice": "This is free and unencumbered software released into the public domain.",
}
#: Words of a shingle; a shorter template is one shingle.
SHINGLE = 5
#: Shingles of a block; a window is two neighbouring blocks, so windows overlap by half.
BLOCK = 4
#: Bands of one hash each. A window that shares the part j of its shingles with a
#: template's window meets it with probability 1 - (1 - j) ** BANDS; of the windows
#: over a match of containment 0.8, one has j of 0.45 or more: 0.99 at least.
BANDS = 8
CONTAINED = 0.8
#: Foreign words that a region can hold in a row: so many, or a fourth of the template's shingles if that is more.
GAP = 10


def _words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(hashed: str, k: int) -> Column:
    """A hash of each run of ``k`` words, from the words' hashes; none if there are fewer."""
    n = F.size(hashed)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(F.col(hashed), i + j) for j in range(k))))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: str, k: int) -> Column:
    """Each run of ``k`` words, as text."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))
    return F.when(n >= k, each).otherwise(F.array().cast("array<string>"))


def _each(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _band(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, k (words of its shingles) and shingles (distinct) of each text."""
    t = spark.createDataFrame(sorted(texts.items()), "license string, text string").withColumn("words", _words(F.col("text")))
    t = t.where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    return t.select("license", "k", F.transform(F.sequence(F.lit(0), F.size("words") - F.col("k")), lambda i: F.array_join(F.slice("words", i + 1, F.col("k")), " ")).alias("shingles"), "words")


def _template_keys(t: DataFrame) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """By shingle length, the hashes of all shingles, and what retrieves a
    template: a short one's shingles, each a window of its own; of a long one
    each window's least hash in each band."""
    t = t.withColumn("wh", _each("words"))
    ks = [r[0] for r in t.select("k").distinct().collect()]
    hashed = t.withColumn("h", F.coalesce(*(F.when(F.col("k") == k, _hashes("wh", k)) for k in ks)))
    long = F.size("h") >= 2 * BLOCK
    at = F.sequence(F.lit(0), F.size("h") - 2 * BLOCK)
    bands = F.flatten(F.array(*(_windows(at, b) for b in range(BANDS))))
    rows = hashed.select("k", "h", F.when(long, bands).otherwise(F.col("h")).alias("keys")).collect()  # as many as templates
    of = lambda name: {k: sorted({x for r in rows if r["k"] == k for x in r[name]}) for k in ks}
    return of("h"), of("keys")


def _windows(at: Column, band: int) -> Column:
    return F.transform(at, lambda i: _band(F.slice("h", i + 1, 2 * BLOCK), band))


def scan(documents: DataFrame, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """Where templates stand in documents.

    Windows of two blocks of BLOCK shingles, and single shingles, are looked up
    among the templates' by the least of BANDS hashes. Documents that hit are
    compared with the templates exactly: shared shingles, with at most GAP foreign words or a
    fourth of the template's shingles between them, make a region, and a region counts if it holds CONTAINED of the
    template's distinct shingles. Texts that hit nothing are done in one pass
    without a shuffle; regions are put together by document. What is looked up
    grows with ``texts``, which the caller bounds, not with ``documents``.

    Returns doc_id, license, start (word), n_words, containment. Words are runs
    of letters and digits, lower-cased, so punctuation doesn't matter. Null and
    empty texts match nothing. Rows that repeat id and text count once; a null
    id is an id. Other columns don't matter. No rows, or no template: no matches.
    """
    spark = documents.sparkSession
    schema = "doc_id " + documents.schema["doc_id"].dataType.simpleString() + ", license string, start int, n_words int, containment double"
    if not texts:
        return spark.createDataFrame([], schema)
    t = templates(spark, texts)
    shingles, keys = _template_keys(t)
    d = documents.select(documents["doc_id"].alias("doc_id"), F.xxhash64(documents["text"]).alias("text_hash"), _words(documents["text"]).alias("words")).withColumn("wh", _each("words"))
    # two windows can only meet in a shingle that both hold, so texts without any of the templates' need no bands
    d = d.withColumns({f"h{k}": _hashes("wh", k) for k in keys})
    d = _only(d, _any(F.exists(f"h{k}", _among(found)) for k, found in sorted(shingles.items())))
    hits = [F.exists(f"h{k}", _among(found)) for k, found in sorted(keys.items())]
    if SHINGLE in keys:
        h = F.col(f"h{SHINGLE}")
        blocks = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.floor((F.size(h) - 1) / BLOCK).cast("int")))
        d = d.withColumns({f"m{band}": F.transform(blocks, _block(h, band)) for band in range(BANDS)})
        hits += [F.coalesce(F.exists(F.transform(F.col(f"m{band}"), _both(f"m{band}")), _among(keys[SHINGLE])), F.lit(False)) for band in range(BANDS)]
    d = _only(d, _any(hits)).select("doc_id", "text_hash", "words")

    ours = t.select("license", "k", F.size(F.array_distinct("shingles")).alias("of"), F.explode(F.array_distinct("shingles")).alias("shingle"))
    every = F.concat(*(F.transform(_shingles("words", k), _placed(k)) for k in sorted(keys)))
    m = d.select("doc_id", "text_hash", F.inline(every)).join(F.broadcast(ours), ["k", "shingle"]).distinct()
    order = Window.partitionBy("doc_id", "text_hash", "license").orderBy("at")
    m = m.withColumn("opens", F.coalesce(F.col("at") - F.lag("at").over(order) - F.col("k") > F.greatest(F.lit(GAP), F.floor(F.col("of") / 4)), F.lit(True)).cast("int")).withColumn("region", F.sum("opens").over(order))
    r = m.groupBy("doc_id", "text_hash", "license", "of", "k", "region").agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + F.col("k")).alias("n_words"), F.count_distinct("shingle").alias("n"))
    return r.where(F.col("n") >= CONTAINED * F.col("of")).select("doc_id", "license", "start", "n_words", (F.col("n") / F.col("of")).alias("containment"))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _only(d: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet ``condition``, by a generator: a filter would be pushed down
    and would work out whole columns again for every element."""
    return d.select("*", F.explode(F.when(condition, F.array(F.lit(1)))).alias("__one")).drop("__one")


def _placed(k: int):
    return lambda x, at: F.struct(F.lit(k).alias("k"), at.alias("at"), x.alias("shingle"))


def _among(keys: list[int]):
    return lambda x: x.isin(keys)


def _block(h: Column, band: int):
    return lambda j: _band(F.slice(h, j * BLOCK + 1, BLOCK), band)


def _both(minima: str):
    return lambda x, j: F.least(x, F.get(F.col(minima), j + 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
SQL = rf"""
WITH lic(license, text) AS (VALUES {_VALUES}),
tw AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM lic),
tk AS (SELECT license, w, least(len(w), 5)::INT AS k FROM tw),
ts AS (SELECT DISTINCT license, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS shingle FROM tk),
tn AS (SELECT license, count(*) AS n_of FROM ts GROUP BY license),
ks AS (SELECT DISTINCT k FROM ts),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
x AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, license, pos, x.k, shingle FROM x JOIN ts ON ts.k = x.k AND ts.shingle = array_to_string(w[pos + 1:pos + x.k], ' ')),
o AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, license ORDER BY pos) - m.k <= greatest({GAP}, floor(n_of / 4)) THEN 0 ELSE 1 END AS opens FROM m JOIN tn USING (license)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, license ORDER BY pos) AS region FROM o),
g AS (SELECT doc_id, license, region, min(pos) AS start, max(pos) - min(pos) + any_value(k) AS n_words, count(DISTINCT shingle) AS n FROM r GROUP BY ALL)
SELECT doc_id, license, start::INT AS start, n_words::INT AS n_words, n / n_of AS containment FROM g JOIN tn USING (license) WHERE n >= {CONTAINED} * n_of
"""
QUERIES, ORACLES = {"op1_license_scan": query}, {"op1_license_scan": SQL}
