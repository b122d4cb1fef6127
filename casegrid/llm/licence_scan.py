"""Licence notices by paragraph: a trained classifier, confirmed by comparison with templates.

A paragraph is a line, or a line with those that follow it where a notice is wrapped. Candidates are
all that share a word 2-gram with any template, so none that could be confirmed is left out. Sparse word
1- and 2-grams of a candidate go through a multinomial logistic regression over licence families and
``unknown``, fitted on all candidates of one half of the documents; a family counts where its probability
passes a threshold calibrated on all those of the other half and a template of the family shares enough word 2-grams with the paragraph. DataFrame and
SQL functions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegrid.session import scratch_path

UNKNOWN = "unknown"
# Words of public licence texts and notices, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with"
        " the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL, version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal; no copyright is claimed.",
        "This is free and unencumbered software released into the public domain without copyright.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "Proprietary and confidential. Unauthorized copying of this file is prohibited; all rights reserved.",
    ),
}
# A line with one of these is scored (and reported as unknown) even if it shares no 2-gram.
ANCHORS = ("licens", "licenc", "rights reserved", "copyright", "permission", "redistribut", "warrant", "public domain")

FEATURES = 1 << 13
# Rows that a task of the fit reads at least: each sends a gradient of all features and classes in every round.
ROWS_A_TASK = 50_000
# Weight of all background candidates together, times that of the templates' rows: however many they are,
# the families stay as likely.
BACKGROUND_WEIGHT = 4
MIN_SIMILARITY = 0.6  # share of a template's 2-grams
LEAST_THRESHOLD = 0.5
# Background paragraphs share less of every template than this; between it and MIN_SIMILARITY are parts of notices.
BACKGROUND_SIMILARITY = MIN_SIMILARITY / 2


def _plain_words(text: str) -> list[str]:
    """``_words`` for the templates, which are ASCII."""
    return re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", text.lower())


TEMPLATE_PAIRS = [
    (family, k, sorted({" ".join(p) for p in zip(w, w[1:])}))
    for family, texts in TEMPLATES.items() for k, w in enumerate(map(_plain_words, texts))
]
# A wrapped notice goes on for so many words after its first line at most, hence for so many lines.
MAX_WORDS = max(len(_plain_words(t)) for texts in TEMPLATES.values() for t in texts)


def _words(text: Column) -> Column:
    r"""Lower-case runs of letters, digits, ``.`` and ``-`` inside, the marks around them taken off."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def _pairs(words: Column) -> Column:
    return _let(words, lambda ws: F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1))
    ))


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds ``words`` and ``grams`` (1- and 2-grams) to paragraphs."""
    return df.withColumn("words", _words(F.col("paragraph"))).withColumn("grams", F.concat("words", _pairs(F.col("words"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, not again for every element of a lambda in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _hits(words: Column) -> Column:
    """The distinct 2-grams that some template has."""
    # Looked up in one constant set; array_intersect would build a set of all of them for every line.
    known = sorted({p for _, _, pairs in TEMPLATE_PAIRS for p in pairs})
    return F.array_distinct(F.filter(_pairs(words), lambda p: p.isin(known)))


def _shares(hits: Column) -> Column:
    """Every template's ``share`` of 2-grams in ``hits``, its ``k`` (negative number), ``family`` and ``pairs``."""
    templates = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(k).alias("k"), _strings(p).alias("pairs")) for f, k, p in TEMPLATE_PAIRS))
    return _let(hits, lambda h: F.transform(templates, lambda t: F.struct(
        (F.size(F.array_intersect(t["pairs"], h)) / F.size(t["pairs"])).alias("share"), (-t["k"]).alias("k"), t["family"].alias("family"),
        t["pairs"].alias("pairs"),
    )))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, row, no, words, hits, closest`` of all lines that share a 2-gram with a template or hold an anchor.

    ``row`` tells rows of one doc_id apart. ``words`` are the line's own; where the line alone is not close
    to a template, but is together with the lines that follow it and adds 2-grams that those do not have,
    they are joined, up to the last line that has part of the notice. Lines are joined up to one without
    words, and as long as they begin within ``MAX_WORDS`` words behind the first. ``closest`` is the largest
    share of any template.
    """
    def cut(lines: Column) -> Column:
        # With the next line's first word, so that the 2-gram across the break counts.
        def numbered(lines: Column, words: Column) -> Column:
            return F.transform(words, lambda w, i: F.struct(
                i.alias("no"), w.alias("words"), _hits(F.concat(w, F.slice(F.coalesce(F.get(words, i + 1), F.array().cast("array<string>")), 1, 1))).alias("hits"),
                _has_anchor(F.get(lines, i)).alias("anchor"),
            ))

        def followed(rows: Column) -> Column:
            def tail(r: Column) -> Column:
                start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))
                end = F.aggregate(F.slice(rows, r["no"] + 2, F.lit(MAX_WORDS)), start, lambda s, x: F.when(
                    s["open"] & (F.size(x["words"]) > 0) & (s["size"] < MAX_WORDS),
                    F.struct((s["n"] + 1).alias("n"), (s["size"] + F.size(x["words"])).alias("size"), F.lit(True).alias("open")),
                ).otherwise(F.struct(s["n"].alias("n"), s["size"].alias("size"), F.lit(False).alias("open"))))
                return F.slice(rows, r["no"] + 2, end["n"])

            found = F.filter(rows, lambda r: r["anchor"] | (F.size(r["hits"]) > 0))
            return F.transform(found, lambda r: F.struct(r.alias("line"), F.transform(
                F.when(F.size(r["hits"]) > 0, tail(r)).otherwise(F.slice(rows, 1, 0)), lambda x: F.struct(x["words"].alias("words"), x["hits"].alias("hits"))
            ).alias("tail")))

        return _let(lines, lambda ls: _let(F.transform(ls, _words), lambda words: _let(numbered(ls, words), followed)))

    found = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("row"), F.explode(_let(F.split("text", "\n", -1), cut)).alias("x"))
        .select("doc_id", "row", F.col("x.line.no").alias("no"), F.col("x.line.words").alias("own"), F.col("x.line.hits").alias("first"), F.col("x.tail").alias("tail"))
    )

    def best(hits: Column) -> Column:
        return F.array_max(_shares(hits))

    def joined(own: Column, first: Column, tail: Column) -> Column:
        """Words of the wrapped notice, or null."""
        def with_template(t: Column) -> Column:
            mine = F.array_except(F.array_intersect(first, t["pairs"]), F.flatten(tail["hits"]))
            last = F.array_max(F.transform(tail, lambda x, i: F.when(F.arrays_overlap(x["hits"], t["pairs"]), i + 1).otherwise(1)))
            return F.when(
                (t["share"] >= MIN_SIMILARITY) & (F.size(mine) > 0), F.concat(own, F.flatten(F.slice(tail, F.lit(1), last)["words"]))
            )

        return _let(best(F.array_distinct(F.concat(first, F.flatten(tail["hits"])))), with_template)

    # Too few 2-grams for the smallest template need no comparison.
    fewest = min(-(-int(MIN_SIMILARITY * 1000) * len(p) // 1000) for _, _, p in TEMPLATE_PAIRS)
    enough = (F.size("tail") > 0) & (F.size(F.array_distinct(F.concat("first", F.flatten(F.col("tail")["hits"])))) >= fewest)
    alone = _let(best(_hits(F.col("own"))), lambda t: t["share"] >= MIN_SIMILARITY)
    words = F.when(enough & ~alone, joined(F.col("own"), F.col("first"), F.col("tail")))
    return (
        found.select("doc_id", "row", "no", F.coalesce(words, F.col("own")).alias("words"))
        .withColumn("hits", _hits(F.col("words"))).withColumn("closest", F.array_max(F.transform(_shares(F.col("hits")), lambda t: t["share"])))
    )


def _has_anchor(text: Column) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(ANCHORS[0]))
    for anchor in ANCHORS[1:]:
        found = found | F.contains(low, F.lit(anchor))
    return found


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    return _with_grams(spark.createDataFrame(rows, "family string, template int, paragraph string"))


def _background(found: DataFrame, fold: int) -> DataFrame:
    """``features`` of the candidates that are no part of a notice, of that half of the documents."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("licence")), F.lit(2))
    return found.where((part == fold) & (F.col("closest") < BACKGROUND_SIMILARITY)).select("features")


def _with_features(df: DataFrame) -> DataFrame:
    """Adds ``features`` of ``grams``."""
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(df)


def fit(found: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """The model, its classes and the threshold, of all ``found`` candidates.

    Positive rows are the templates whole, and each with one word left out. Negative rows are all background
    candidates of one half of the documents, and the single words of each template without its 2-grams; the
    former weigh ``BACKGROUND_WEIGHT`` times as much as the positive rows at most, all together. The
    threshold is the largest probability of any family among all background candidates of the other half,
    and at least ``LEAST_THRESHOLD``.
    """
    spark = found.sparkSession
    classes = [UNKNOWN, *TEMPLATES]
    whole = _templates(spark)
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    variants = whole.select(
        "family",
        F.explode(F.concat(
            F.array("words"),
            F.transform("words", lambda _, i: F.filter("words", lambda __, j: j != i)),
        )).alias("words"),
    ).select("family", F.concat("words", _pairs(F.col("words"))).alias("grams"), F.lit(1.0).alias("weight"))
    # Single words of licences in another order are not a licence.
    loose = whole.select(F.lit(UNKNOWN).alias("family"), F.array_sort("words").alias("grams"), F.lit(1.0).alias("weight"))
    fitted = _background(found, 0)
    n = fitted.count()
    share = min(1.0, BACKGROUND_WEIGHT * variants.count() / max(1, n))
    # Equal candidates are one row, which weighs as much as all of them.
    background = fitted.groupBy("features").agg((F.count("*") * share).alias("weight")).select(F.lit(UNKNOWN).alias("family"), "features", "weight")
    rows = _with_features(variants.unionByName(loose)).drop("grams").unionByName(background).withColumn("label", index.cast("double"))
    tasks = max(spark.sparkContext.defaultParallelism, n // ROWS_A_TASK)
    data = rows.select("label", "weight", "features").coalesce(tasks).cache()
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, standardization=False, weightCol="weight").fit(data)
    data.unpersist()
    held_out = model.transform(_background(found, 1)).select(_best("probability").alias("best"))
    highest = held_out.agg(F.max("best.p")).first()[0]
    return model, classes, max(LEAST_THRESHOLD, float(highest or 0.0))


def _best(column: str) -> Column:
    """Probability and index of the best family; class 0 is unknown."""
    p = vector_to_array(column)
    return F.array_max(F.transform(F.slice(p, 2, F.size(p) - 1), lambda v, i: F.struct(v.alias("p"), (i + 1).alias("k"))))


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, family, probability, similarity, template`` of every candidate line.

    Candidates share a word 2-gram with any template, or hold one of ``ANCHORS``; a wrapped notice counts
    for its lines, see ``candidates``. ``family`` is ``unknown`` where the probability of the best family
    is not above the calibrated threshold, or where no template of the family has ``MIN_SIMILARITY`` of its
    2-grams in the paragraph. ``probability`` and ``similarity`` (rounded to 6 places) are those of the best
    family in any case. A null or empty text has no paragraphs. Rows with equal or null ids are scanned one
    by one. Without any background paragraph (an empty table) the result is empty or rests on the templates
    alone.
    """
    # Found once, then read to fit, to calibrate and to score.
    path = scratch_path(docs.sparkSession, "licences")
    grams = candidates(docs).withColumn("grams", F.concat("words", _pairs(F.col("words"))))
    _with_features(grams).select("doc_id", "no", "hits", "closest", "features").write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    model, classes, threshold = fit(found)
    scored = model.transform(found).withColumn("best", _best("probability"))
    scored = scored.select(
        "doc_id", F.col("no").cast("bigint").alias("paragraph_no"), "hits",
        F.col("best.p").alias("p"), F.element_at(F.array(*map(F.lit, classes)), F.col("best.k") + 1).alias("guess"),
    )
    of_family = _let(F.col("guess"), lambda g: F.filter(_shares(F.col("hits")), lambda t: t["family"] == g))
    out = scored.withColumn("close", F.array_max(F.transform(of_family, lambda t: F.struct(t["share"].alias("share"), t["k"].alias("k")))))
    sure = (F.col("p") > threshold) & (F.col("close.share") >= MIN_SIMILARITY)
    return out.select(
        "doc_id", "paragraph_no", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"),
        F.round("p", 6).alias("probability"), F.round("close.share", 6).alias("similarity"),
        (-F.col("close.k")).cast("int").alias("template"),
    )
