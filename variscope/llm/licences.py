"""License scans: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory.

A file's licence passages are its lines with a licence cue, or all its lines if its name or its content is
that of a licence file. Around a cue, runs of words as long as a template that start or end like it are passages
too, across lines, so notices inside a paragraph or wrapped over lines are found. Passages and templates become sparse TF-IDF vectors; a passage names the template
of the highest cosine. Files without a licence of their own take that of the licence files in the nearest
directory above, by joins on directory paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variscope.llm.scratch import stored
from variscope.llm.words import word_count

# The short notices by which the common licences are declared.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0", "Apache License Version 2.0, January 2004"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License version 3",
                "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "GNU General Public License version 2", "GNU General Public License Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later",
                 "GNU Lesser General Public License Version 3, 29 June 2007"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal."],
    "all-rights-reserved": ["All rights reserved."],
}
CUE = r"(?i)licen[cs]e|spdx|all rights reserved|public domain|permission is hereby|redistribution and use|creative commons|\bcc[ -]?(by|0)\b"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
MIN_COSINE = 0.75
#: A file whose passages hold this share of its words is a licence file whatever its name.
FILE_SHARE = 0.5
#: Lines, and words of them, on each side of a line with a cue that a wrapped notice may reach.
AROUND_LINES, AROUND_WORDS = 3, 24
#: A line of more words is also read in runs; shorter lines by themselves are one passage.
LONG_LINE = 24
#: Templates of fewer words are only looked for as whole lines.
LEAST_RUN = 3


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with inner dots and hyphens apart."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(name, n, text) for name, texts in (templates or TEMPLATES).items() for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, variant int, notice string")


def runs(words: Column, templates: DataFrame) -> Column:
    """Runs of ``words`` (an array) that have the length and the first or last word of a template, and a cue."""
    starts: dict[str, set[int]] = {}
    ends: dict[str, set[int]] = {}
    for t in templates.select(terms(F.col("notice")).alias("t")).collect():
        if len(t["t"]) >= LEAST_RUN:
            starts.setdefault(t["t"][0], set()).add(len(t["t"]))
            ends.setdefault(t["t"][-1], set()).add(len(t["t"]))
    if not starts:
        return F.array().cast("array<string>")
    table = lambda d: F.create_map(*[x for w, ns in d.items() for x in (F.lit(w), F.array(*map(F.lit, sorted(ns))))])
    none = F.array().cast("array<int>")
    n = F.size(words)

    def at(w, i):
        first = F.transform(F.filter(F.coalesce(F.try_element_at(table(starts), w), none), lambda k: i + k <= n), lambda k: F.array_join(F.slice(words, i + 1, k), " "))
        last = F.transform(F.filter(F.coalesce(F.try_element_at(table(ends), w), none), lambda k: i + 1 >= k), lambda k: F.array_join(F.slice(words, i + 2 - k, k), " "))
        return F.concat(first, last)

    return F.filter(F.array_distinct(F.flatten(F.transform(words, at))), lambda x: x.rlike(CUE))


def passages(files: DataFrame, templates: DataFrame) -> DataFrame:
    """path, text_words, line, passage: the lines of each file that may declare a licence, and runs around their cues.

    A run has ``run`` set; it adds no words to the file's share and does not count in document frequencies.
    """
    whole = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    kept = files.filter(F.coalesce(whole | F.col("text").rlike(CUE), F.lit(False))).withColumn("_every", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    numbered = F.transform("_every", lambda x, i: F.struct(i.alias("line"), x.alias("passage"), x.rlike(CUE).alias("cue")))
    lines = F.filter(numbered, lambda x: x["cue"] | whole)
    words = lambda a: F.flatten(F.transform(a, terms))
    i = F.col("line")
    before = words(F.slice("_every", F.greatest(i + 1 - AROUND_LINES, F.lit(1)), F.least(i, F.lit(AROUND_LINES))))
    after = F.slice(words(F.slice("_every", i + 2, AROUND_LINES)), 1, AROUND_WORDS)
    before = F.slice(before, F.greatest(F.size(before) - AROUND_WORDS + 1, F.lit(1)), AROUND_WORDS)
    own = terms(F.col("passage"))
    found = kept.select("path", "_row", word_count(F.col("text")).alias("text_words"), whole.alias("named"), "_every", F.inline(lines))
    found = found.withColumn("_around", F.concat(before, own, after)).withColumn("_alone", (F.size(own) <= LONG_LINE) & (F.size("_around") == F.size(own)))
    near = F.when(F.col("cue") & ~F.col("_alone"), runs(F.col("_around"), templates)).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.struct("passage", F.lit(False).alias("run"))), F.transform(near, lambda x: F.struct(x.alias("passage"), F.lit(True).alias("run"))))
    found = found.select("path", "_row", "text_words", "named", "line", F.explode(every).alias("_x"))
    return found.select("path", "_row", "text_words", "named", "line", "_x.passage", "_x.run").filter(F.size(terms(F.col("passage"))) > 0)


def scored(found: DataFrame, templates: DataFrame) -> DataFrame:
    """The best template of each different passage: passage, license, cosine.

    Document frequencies count all passages and templates; a template's idf is that of the corpus too. Equal
    passages are one vector, so a notice in a third of all files is scored once.
    """
    distinct = found.groupBy("passage").agg(F.count(F.when(~F.col("run"), 1)).alias("copies"))
    vectors = distinct.select("passage", "copies", F.explode(terms(F.col("passage"))).alias("term")).groupBy("passage", "copies", "term").agg(F.count("*").alias("tf"))
    model = templates.select("license", "variant", F.explode(terms(F.col("notice"))).alias("term")).groupBy("license", "variant", "term").agg(F.count("*").alias("tf"))
    n = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"] + templates.count()
    seen = vectors.select("term", "copies").unionByName(model.select("term", F.lit(1).cast("long").alias("copies")))
    idf = stored(seen.groupBy("term").agg((F.log((F.lit(n) + 1) / (F.sum("copies") + 1)) + 1).alias("idf")), "idf")
    weighed = vectors.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    notices = model.join(idf, "term").withColumn("v", F.col("tf") * F.col("idf"))
    length = notices.groupBy("license", "variant").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v_norm"))
    postings = notices.join(length, ["license", "variant"]).select("term", F.struct("license", "variant", (F.col("v") / F.col("v_norm")).alias("v")).alias("_posting"))
    # One row a term of the templates.
    postings = postings.groupBy("term").agg(F.collect_list("_posting").alias("_postings"))
    norms = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(postings, "term").select("passage", "w", F.inline("_postings")).groupBy("passage", "license", "variant").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, "passage").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    best = cosine.groupBy("passage").agg(F.max_by(F.struct("license", "cosine"), F.struct(F.col("cosine"), F.col("license"))).alias("_best"))
    return best.select("passage", "_best.license", "_best.cosine")


def directory_of(path: Column) -> Column:
    """Everything before the last '/'; '' for a file at the top, null for none."""
    above = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))
    return F.regexp_replace(above, "/+$", "")


def ancestors(directory: Column) -> Column:
    """A directory and those above it, nearest first, down to ''."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scan(files: DataFrame, templates: DataFrame | None = None, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """Add ``license``, ``cosine``, ``how`` ('own', 'inherited' or null) and ``from_dir`` to every row of ``files``.

    ``files`` has path and text; other columns stay. A file's own licence is that of its best passage, ties by
    name. A directory's licence comes from its licence files, the best cosine first, ties by licence name. A
    null path inherits nothing; null and empty texts have no licence of their own; rows are judged one by one,
    so repeated rows agree. Names that the result adds must be free.
    """
    taken = {"license", "cosine", "how", "from_dir"} & set(files.columns)
    if taken:
        raise ValueError(f"the input has columns that the scan adds: {sorted(taken)}")
    # Rows of one path and text are alike, so they are scanned through a key of both.
    keyed = files.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))
    models = templates if templates is not None else template_table(files.sparkSession)
    found = stored(passages(keyed.select("path", "text", "_row"), models), "passages")
    names = scored(found, models)
    matched = found.join(names.filter(F.col("cosine") >= min_cosine), "passage").withColumn("passage_words", F.when(F.col("run"), 0).otherwise(word_count(F.col("passage"))))
    own = matched.groupBy("path", "_row").agg(
        F.max_by(F.struct("license", "cosine"), F.struct(F.col("cosine"), F.col("license"))).alias("_own"),
        F.max("named").alias("named"),
        F.max("text_words").alias("text_words"),
        F.sum("passage_words").alias("passage_words"),
        F.countDistinct(F.when(~F.col("run"), F.col("line"))).alias("_lines"),
        F.greatest(F.count(F.when(~F.col("run"), 1)), F.lit(1)).alias("_all"),
    )
    # Repeated rows bring their passages once each.
    own = stored(own.withColumn("passage_words", F.col("passage_words") * F.col("_lines") / F.col("_all")), "own")
    sources = own.filter(F.col("named") | (F.col("passage_words") >= file_share * F.col("text_words"))).filter("path IS NOT NULL")
    at = sources.select(directory_of(F.col("path")).alias("_dir"), "_own.license", "_own.cosine")
    granted = at.groupBy("_dir").agg(F.max_by(F.struct("license", "cosine"), F.struct(F.col("cosine"), F.col("license"))).alias("_granted"))
    # Directories, not files, climb the tree.
    dirs = files.filter("path IS NOT NULL").select(directory_of(F.col("path")).alias("_d")).distinct()
    climbs = dirs.select("_d", F.posexplode(ancestors(F.col("_d"))).alias("_up", "_dir")).join(granted, "_dir")
    nearest = climbs.groupBy("_d").agg(F.min_by(F.struct("_granted", F.col("_dir").alias("from_dir")), F.col("_up")).alias("_near"))
    named = own.select(F.col("path").alias("_p"), F.col("_row").alias("_r"), "_own")
    rows = keyed.join(named, F.col("path").eqNullSafe(F.col("_p")) & (F.col("_row") == F.col("_r")), "left").withColumn("_d2", directory_of(F.col("path")))
    rows = rows.join(nearest, F.col("_d2") == F.col("_d"), "left")
    mine = F.col("_own").isNotNull()
    return rows.select(
        *[F.col(f"`{c}`") for c in files.columns],
        F.when(mine, F.col("_own.license")).otherwise(F.col("_near._granted.license")).alias("license"),
        F.when(mine, F.col("_own.cosine")).otherwise(F.col("_near._granted.cosine")).alias("cosine"),
        F.when(mine, F.lit("own")).when(F.col("_near").isNotNull(), F.lit("inherited")).alias("how"),
        F.when(~mine, F.col("_near.from_dir")).alias("from_dir"),
    )
