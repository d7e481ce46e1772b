"""Licence notices in texts: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import staged

FEATURES = 1 << 12
TRAIN_PARAGRAPHS = 4_000
MIN_SIMILARITY = 0.6
# Share of ordinary paragraphs of the fold kept aside that may be taken for a licence.
FALSE_SHARE = 0.001
# Every so-manieth text by hash is kept aside; chances and similarities are counted in so many steps.
FOLDS, STEPS = 5, 1_000
# Lines with such a word may be notices in a wording that no template has.
SEEDS = (
    r"licen[sc]|lizenz|copyright|copyleft|©|permission|permitted|redistribut|warrant|public domain|rights reserved|"
    r"creative commons|open.source|\b(spdx|[al]?gpl|cc|cc0|bsd|mpl|isc|mit|eupl|wtfpl)\b"
)
NONE, UNKNOWN = "none", "unknown"

# Notices as the licences' own texts and common usage word them, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
}
# Sentences on licences that license nothing here, and wordings of no family above.
OTHERS = [
    "His driving license was taken from him last year.",
    "You need a fishing license to fish in this lake.",
    "All rights reserved.",
    "The version of the story that she told was not true.",
    "Software is released every month.",
    "The public is free to visit the work of the foundation.",
]
FRAMES = ["{}", "Note: {}", "{} See the file for details.", "(c) The authors. {}"]


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits, and the dots and dashes inside them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.\-]+|\.(?=\s|$)"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    )
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, paragraph (from 0), words, and the one- and two-word features of each line of a whole text."""
    # words are made before the lines are dealt out as rows, so that they are made once
    lines = F.transform(F.split(F.col(text_col), "\n", -1), words_of)
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(lines).alias("paragraph", "words")).filter(F.size("words") > 0)


def featured(rows: DataFrame) -> DataFrame:
    grams = rows.withColumn("terms", F.concat("words", _grams(F.col("words"), 2)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(grams).drop("terms")


@dataclass
class Classifier:
    model: LogisticRegressionModel
    families: list[str]
    threshold: float
    similarity: float = MIN_SIMILARITY


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_PARAGRAPHS) -> Classifier:
    """Learn families from the templates, and what is no licence from about ``most`` paragraphs of ``docs``.

    The paragraphs learned from are of texts drawn by hash. Paragraphs that hold a template's three
    words in a row or one of ``SEEDS`` are left out, as their label is not known. The threshold is
    chosen on all other lines of every ``FOLDS``-th text of the table: the smallest chance of being a
    licence that at most ``FALSE_SHARE`` of those lines reach (or one line of fewer than a thousand),
    and no less than a half. Of the lines that reach it no larger share may be confirmed by a
    template: the similarity for that is raised over ``MIN_SIMILARITY`` if it has to be.
    """
    spark = docs.sparkSession
    families = [NONE, *TEMPLATES]
    known = [{"label": families.index(f), "line": frame.format(t)} for f, ts in TEMPLATES.items() for t in ts for frame in FRAMES]
    known += [{"label": 0, "line": frame.format(t)} for t in OTHERS for frame in FRAMES[:2]]
    given = _literal(spark, known, "label:int,line:string").select("label", words_of(F.col("line")).alias("words"))
    # by the text, so that rows with a null id or a copy of a text need no care
    aside = F.pmod(F.xxhash64(F.col(text_col), F.lit(31)), F.lit(FOLDS)) == 0
    share = max(1, most // 4) / max(1, docs.count()) * FOLDS / (FOLDS - 1)
    drawn = docs.filter(~aside & (F.pmod(F.xxhash64(F.col(text_col), F.lit(32)), F.lit(1 << 40)) < share * (1 << 40)))
    some = ordinary(paragraphs(drawn, id_col, text_col)).withColumn("at", F.xxhash64("words")).dropDuplicates(["at"])
    plain = staged(some.orderBy("at").limit(most).select(F.lit(0.0).alias("label"), "words", "at"), "plain-paragraphs")
    rows = featured(given.select(F.col("label").cast("double").alias("label"), "words").unionByName(plain.drop("at")))
    weight = F.when(F.col("label") == 0, 1.0).otherwise(8.0)
    train = staged(rows.select("label", "features", weight.alias("weight")), "licence-training")
    model = LogisticRegression(regParam=1e-3, maxIter=40, weightCol="weight", family="multinomial").fit(train)
    # at most ``most`` keys: lines that were learned say nothing about others
    new = ordinary(paragraphs(docs.filter(aside), id_col, text_col)).withColumn("at", F.xxhash64("words"))
    new = new.join(F.broadcast(plain.select("at")), "at", "left_anti")
    scored = model.transform(featured(new)).select("words", F.explode(F.array(vector_to_array("probability"))).alias("p"))
    may_be = 1 - F.get("p", 0) >= 0.5
    # words and chances only of the few lines that any threshold lets pass
    kept = scored.select(_step(1 - F.get("p", 0)).alias("step"), *[F.when(may_be, F.col(c)).alias(c) for c in ("words", "p")])
    kept = staged(kept, "licence-fold")
    threshold = max(0.5, _least(kept))
    told = _guessed(kept.filter(1 - F.get("p", 0) >= threshold), families)
    told = told.select("row").join(similarities(told), "row", "left").select(_step(F.coalesce("similarity", F.lit(0.0))).alias("step"))
    return Classifier(model, families, threshold, max(MIN_SIMILARITY, _least(told)))


def ordinary(lines: DataFrame) -> DataFrame:
    """Lines that hold no template's three words in a row and no word that licences are known by."""
    wording = F.split(F.lit("\n".join(sorted(template_grams()))), "\n")
    return lines.filter(~F.concat_ws(" ", "words").rlike(SEEDS) & ~F.arrays_overlap(_grams(F.col("words"), 3), wording))


def _step(share: Column) -> Column:
    return F.least(F.floor(share * STEPS), F.lit(STEPS - 1)).cast("int")


def _least(steps: DataFrame) -> float:
    """The smallest step that at most ``FALSE_SHARE`` of all rows reach, or one row; no higher than the last step."""
    counts = {r["step"]: r["count"] for r in steps.groupBy("step").count().collect()}
    room = max(1.0, FALSE_SHARE * sum(counts.values()))
    for step in range(STEPS - 1, -1, -1):
        room -= counts.get(step, 0)
        if room < 0:
            return min(step + 1, STEPS - 1) / STEPS
    return 0.0


def _literal(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A few fixed rows, made in the JVM from one text."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w.\-]+|\.(?=\s|$)", text.lower()) if w]


def template_grams() -> set[str]:
    """Every three words in a row of every template."""
    found = set()
    for texts in TEMPLATES.values():
        for t in texts:
            w = _plain_words(t)
            found |= {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}
    return found


def similarities(named: DataFrame) -> DataFrame:
    """row, similarity of named(row, words, guess): how much of a paragraph and of the family's best template agree, 0 to 1.

    Compared by distinct pairs of words: the share of the template's that are in the paragraph, or of
    a paragraph of four words or more that are in the template, so a notice inside a longer line and
    a part of a wrapped notice both count. The templates are a fixed table, so it is broadcast.
    """
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = _plain_words(t)
            pairs = sorted({" ".join(w[k : k + 2]) for k in range(len(w) - 1)})
            rows += [{"guess": family, "template": t, "pair": p, "wanted": len(pairs)} for p in pairs]
    templates = F.broadcast(_literal(named.sparkSession, rows, "guess:string,template:string,pair:string,wanted:int"))
    held = named.select("row", "guess", F.array_distinct(_grams(F.col("words"), 2)).alias("own"))
    both = held.select("row", "guess", F.size("own").alias("size"), F.explode("own").alias("pair")).join(templates, ["guess", "pair"])
    per = both.groupBy("row", "template", "size", "wanted").agg(F.count("*").alias("both"))
    part = F.when(F.col("size") >= 3, F.col("both") / F.col("size")).otherwise(0.0)
    return per.groupBy("row").agg(F.max(F.greatest(F.col("both") / F.col("wanted"), part)).alias("similarity"))


def _guessed(likely: DataFrame, families: list[str]) -> DataFrame:
    """A staged table with the likeliest family of each row, its chance, and a number for the row."""
    names = F.array(*[F.lit(f) for f in families])
    best = likely.withColumn("probability", F.array_max(F.slice("p", 2, len(families) - 1)))
    guess = F.get(names, (F.array_position("p", F.col("probability")) - 1).cast("int"))
    return best.withColumn("guess", guess).withColumn("row", F.monotonically_increasing_id())


def find_licenses(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``paragraph``, ``family``, ``probability``, ``similarity``: a row per licence paragraph.

    A paragraph is a line of the whole text, counted from 0. It is reported when its chance of being a
    licence reaches the threshold: under the likeliest family if a template of it confirms that by
    the similarity found by ``fit``, else as ``unknown``. Null and empty texts and lines without a word give no
    rows. Rows that repeat, or have a null id, are reported each. Other columns are not looked at.
    """
    scored = classifier.model.transform(featured(paragraphs(docs, id_col, text_col))).select(
        # a one-row explode keeps the filter below from working the chances out a second time
        "doc", "paragraph", "words", F.explode(F.array(vector_to_array("probability"))).alias("p")
    )
    # few of all lines; from here on only these are looked at
    likely = staged(scored.filter(1 - F.get("p", 0) >= classifier.threshold), "licence-lines")
    named = _guessed(likely, classifier.families)
    told = named.join(similarities(named), "row", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return told.select(
        F.col("doc").alias(id_col),
        "paragraph",
        F.when(F.col("similarity") >= classifier.similarity, F.col("guess")).otherwise(UNKNOWN).alias("family"),
        "probability",
        "similarity",
    )
