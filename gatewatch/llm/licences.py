"""Licence scans: TF-IDF cosine of licence lines, files and word windows to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm.staging import small, staged

CUES = r"(?i)licen[cs]|copyright|spdx|warrant|hereby|redistribut"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[^a-z0-9.+-]+"

# The short notices, headers, titles and telling passages by which files and licence texts state well-known licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software. For more information, please refer to unlicense.org"),
] + [(name, f"SPDX-License-Identifier: {tag}") for name, tags in (
    ("AGPL-3.0", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"),
    ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"),
    ("GPL-2.0", "GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later"), ("ISC", "ISC"),
    ("LGPL-2.1", "LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later"), ("MIT", "MIT"),
    ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense")) for tag in tags.split()]

# Names without a version, which count only where nothing of the above is stated.
FAMILIES: list[tuple[str, str]] = [("AGPL", "GNU Affero General Public License"), ("Apache", "Apache License"), ("BSD", "BSD License"),
                                   ("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("MPL", "Mozilla Public License")]


PIECE = 512  # words of a text looked through at a time


def _words(text: str) -> list[str]:
    return [w for w in (x.rstrip(".") for x in re.split(TERM, text.lower())) if w]


def _spans(templates: list[tuple[str, str]]) -> dict[str, list[Column]]:
    """By cue word, its place in each template, the template's length and the squared unit weights of its terms."""
    texts = [_words(text) for _, text in templates]
    frequency = Counter(w for own in texts for w in set(own))
    out: dict[str, list[Column]] = {}
    for own in texts:
        squares = {w: (c * (math.log((1 + len(texts)) / (1 + frequency[w])) + 1)) ** 2 for w, c in Counter(own).items()}
        shares = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(x / sum(squares.values())).alias("x")) for w, x in sorted(squares.items())))
        for w in sorted({w for w in own if re.search(CUES, w)}):
            out.setdefault(w, []).append((own.index(w), len(own), F.struct(F.lit(own.index(w)).alias("o"), F.lit(len(own)).alias("n"), shares.alias("shares"))))
    return out


def _windows(words: Column, lists: list[list[tuple[str, str]]], least: float) -> tuple[Column, Column, Column]:
    """A list of words in pieces, what surrounds each cue word of a piece, and from that, as texts, the windows that place a
    template's cue word there. Pieces overlap by what their first and last cue words need, so that no row and no list of distinct
    surroundings grows with the text.

    A window is as long as its template, whatever lines the words are on. Of a cue word that occurs more than once in a template
    the first place counts. By the Cauchy-Schwarz inequality a cosine is at most the root of the template's squared weights
    that are shared; windows that cannot reach ``least`` are left out.
    """
    places: dict[str, list] = {}
    for templates in lists:
        for w, found in _spans(templates).items():
            places.setdefault(w, []).extend(found)
    if not places:
        return F.array(F.lit(None)), F.array(F.lit(None)), F.array().cast("array<string>")
    before, after = max(o for x in places.values() for o, _, _ in x), max(n - o for x in places.values() for o, n, _ in x)
    cues = F.array(*(F.lit(w) for w in sorted(places)))
    first = lambda c: (c * PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / PIECE).cast("int")), lambda c: F.struct(
        F.least(first(c), F.lit(before)).alias("from"),
        F.slice(words, F.greatest(first(c) - before, F.lit(0)) + 1, F.least(first(c), F.lit(before)) + PIECE + after).alias("words")))
    own, start = F.col("piece.words"), F.col("piece.from")
    hits = F.filter(F.transform(own, lambda w, i: F.when((i >= start) & (i < start + PIECE) & F.array_contains(cues, w), i)), lambda i: i.isNotNull())
    around = F.array_distinct(F.transform(hits, lambda i: F.struct(
        F.least(i, F.lit(before)).alias("at"), F.get(own, i).alias("cue"), F.slice(own, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + after).alias("near"))))
    spans = F.create_map(*(x for w in sorted(places) for x in (F.lit(w), F.array(*(c for _, _, c in places[w])))))
    at, near = F.col("around.at"), F.col("around.near")
    cut = F.transform(F.element_at(spans, F.col("around.cue")), lambda x: F.struct(F.slice(near, F.greatest(at - x["o"], F.lit(0)) + 1, x["n"]).alias("own"), x["shares"].alias("shares")))
    bound = lambda c: F.aggregate(c["shares"], F.lit(0.0), lambda a, x: a + F.when(F.array_contains(c["own"], x["w"]), x["x"]).otherwise(0.0))
    able = F.filter(cut, lambda c: bound(c) >= least * least - 1e-4)
    return pieces, around, F.array_distinct(F.transform(able, lambda c: F.array_join(c["own"], " ")))


def _terms(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), TERM), lambda t: F.rtrim(t, F.lit("."))), lambda t: t != "")


def _vectors(segments: DataFrame, keys: list[str], weights: DataFrame, unknown: float) -> DataFrame:
    """Rows (keys, term, weight) of unit length: counts times inverse document frequency."""
    counts = segments.select(*keys, F.explode(_terms(F.col("segment"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(weights), "term", "left").select(*keys, "term", (F.col("n") * F.coalesce("idf", F.lit(unknown))).alias("weight"))


def matched(segments: DataFrame, templates: list[tuple[str, str]], least: float, spark: SparkSession) -> DataFrame:
    """Best template per file over segments(file, part, segment): file, licence, cosine, terms. Equal cosines go to the template of
    more terms, then to the first name.

    Terms that no template has weigh most; they only lengthen a segment's vector. The templates are a fixed list, the one
    side that is sent to all tasks.
    """
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, segment string")
    n = len(templates)
    weights = known.select(F.explode(F.array_distinct(_terms(F.col("segment")))).alias("term")).groupBy("term").agg(
        (F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    unknown = math.log(1.0 + n) + 1
    models = _vectors(known, ["template"], weights, unknown)
    norms = models.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    models = models.join(F.broadcast(norms), "template").select("template", "term", (F.col("weight") / F.col("norm")).alias("model"))
    rows = _vectors(segments, ["file", "part"], weights, unknown)
    # One list of shared weights per segment keeps its length and all its products in a single sum.
    models = models.groupBy("term").agg(F.collect_list(F.struct("template", "model")).alias("models"))
    hits = rows.join(F.broadcast(models), "term", "left").select("file", "part", "weight", F.explode_outer("models").alias("m"))
    length = rows.groupBy("file", "part").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = hits.where("m is not null").groupBy("file", "part", F.col("m.template").alias("template")).agg(F.sum(F.col("weight") * F.col("m.model")).alias("dot"))
    best = dots.join(length, ["file", "part"]).select("file", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= least)
    names = known.select("template", "licence", F.size(_terms(F.col("segment"))).alias("terms"))
    best = best.join(F.broadcast(names), "template").groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("terms")).alias("t"), "licence")).alias("b"))
    return best.select("file", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), (-F.col("b.t")).alias("terms"))


def scan_licences(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.7, id_col: str = "file_id",
                  path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The licence of every file: stated in it, or else that of the nearest directory above that has a licence file.

    Every line of a whole text that holds a licence cue is compared with the templates, and a file named like a licence
    (LICENSE, COPYING, NOTICE) also as a whole; so is, across lines, every window of a template's length around a cue word. A
    licence family without a version counts only where nothing else is stated. The best cosine of at least ``least`` gives ``own_licence``. A licence file
    that matches gives its directory its licence (of several: the best cosine, then the first name). ``from_dir`` is the
    directory a licence comes from. Directories, not files, are joined with their ancestors.

    A null or empty text states nothing; a file with a null path inherits nothing; repeated slashes and a leading one are
    ignored; the root is the empty name. Rows that share an id share what any of them states; they are returned as often as
    they occur. Null ids state nothing but may inherit. An empty table gives no rows. Other columns are ignored.

    Returns the id, path, own_licence, cosine, from_dir, licence.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = files.select(F.col(id_col).alias("file"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_parts", parts).withColumn("dir", F.array_join(F.slice("_parts", 1, F.greatest(F.lit(0), F.size("_parts") - 1)), "/"))
    rows = rows.withColumn("named", F.coalesce(F.element_at("_parts", -1).rlike(LICENCE_FILE), F.lit(False)))
    stating = rows.where((F.col("named") | F.col("text").rlike(CUES)) & F.col("file").isNotNull())
    lines = F.filter(F.split("text", "\r?\n"), lambda x: x.rlike(CUES))
    whole = F.when(F.col("named"), F.concat(F.array("text"), lines)).otherwise(lines)
    lists = [TEMPLATES, FAMILIES] if templates is None else [templates]
    pieces, around, windows = _windows(F.col("words"), lists, least)
    near = stating.select("file", _terms(F.col("text")).alias("words")).select("file", F.explode(pieces).alias("piece")).where("piece is not null")
    near = near.select("file", F.explode(around).alias("around")).where("around is not null")
    segments = stating.select("file", F.explode(whole).alias("segment")).unionAll(near.select("file", F.explode(windows).alias("segment")))
    segments = staged(segments.select("file", F.xxhash64("segment").alias("part"), "segment").dropDuplicates(["file", "part"]), "segments")
    # Equal segments of many files are compared once.
    texts, found = segments.select(F.col("part").alias("file"), F.lit(0).alias("part"), "segment").dropDuplicates(["file"]), None
    for models in lists:
        alike = staged(matched(texts, models, least, files.sparkSession), "alike").withColumnRenamed("file", "part")
        best = segments.select("file", "part").join(small(alike), "part").groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("terms")).alias("t"), "licence")).alias("b"))
        best = best.select("file", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))
        found = staged(best if found is None else found.unionAll(best.join(found.select("file"), "file", "left_anti")), "licences")
    placed = rows.select("file", "path", F.when(F.col("path").isNotNull(), F.col("dir")).alias("dir"), "named")
    roots = placed.where("named and dir is not null").join(small(found), "file").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))["licence"].alias("licence"))
    roots = staged(roots.select(F.col("dir").alias("from_dir"), F.col("licence").alias("given")), "licence-dirs")
    steps = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("s")), lambda i: F.array_join(F.slice("s", 1, i), "/"))
    dirs = placed.select("dir").where("dir is not null").distinct().withColumn("s", steps).select("dir", F.posexplode(above).alias("depth", "from_dir"))
    nearest = dirs.join(small(roots), "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("n")).select("dir", "n.from_dir", "n.given")
    out = placed.join(small(found), "file", "left").join(small(nearest), "dir", "left")
    stated = F.col("licence").isNotNull()
    return out.select(F.col("file").alias(id_col), "path", F.col("licence").alias("own_licence"), "cosine", F.when(~stated, F.col("from_dir")).alias("from_dir"),
                      F.coalesce("licence", "given").alias("licence"))
