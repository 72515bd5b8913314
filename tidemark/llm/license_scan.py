"""Licence scan: a trained paragraph classifier, a calibrated unknown class, confirmation by templates.

Training and scoring use pyspark.ml and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, bounded_sample, text_of, written

UNKNOWN = "unknown"
#: Variants of each template that train (even) and calibrate (odd), and the share of words each leaves out, in percent.
VARIANTS, DROPPED = 24, 12
#: Documents, in hash order of their ids, whose paragraphs stand for the unknown class.
UNKNOWN_DOCUMENTS = 300
#: Share of trigrams, of the shorter of paragraph and template, that confirms.
CONFIRM = 0.6

# Notices and opening paragraphs of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Sentences about licences that grant nothing.
NO_LICENCE = [
    "A driving licence must be shown at the counter.", "The licence fee was raised again this year.", "All rights reserved.",
    "The software is sold under a commercial license; contact sales for terms.", "He lost his license after the accident.",
    "Copyright of the photographs remains with the museum.", "The university granted a license to operate the station.",
    "Please read the license agreement before you install the program.", "Version 2.0 of the file was released under a new name.",
    "The general public may visit the library on weekdays.", "Permission was granted to build the house.", "The foundation is free to publish the work.",
]


class LicenceModel(NamedTuple):
    vectors: CountVectorizerModel
    classifier: LogisticRegressionModel
    calibrator: LogisticRegressionModel
    families: list[str]


def paragraph_words(text: Column) -> Column:
    """Lower-case words; points, quotes and brackets at their ends are cut off."""
    plain = F.regexp_replace(F.lower(text), r"(?<![^\s(\"'])[(\"']+|[.,;:!?)\"']+(?![^\s)\"'.,;])", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_grams(words: Column | str, n: int) -> Column:
    """Runs of ``n`` neighbouring words, joined by a blank."""
    out = F.col(words) if isinstance(words, str) else words
    joined = out
    for k in range(1, n):
        joined = F.zip_with(joined, F.slice(out, k + 1, F.greatest(F.size(out) - k, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(joined, 1, F.greatest(F.size(out) - n + 1, F.lit(0)))


def with_terms(rows: DataFrame) -> DataFrame:
    """Adds ``words`` and ``terms``: all words and pairs of words of ``text``."""
    rows = rows.withColumn("words", paragraph_words(F.col("text")))
    return rows.withColumn("terms", F.concat("words", n_grams("words", 2)))


def paragraphs(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda p: F.rlike(p, F.lit(WORD)))


def _templates(docs: DataFrame) -> DataFrame:
    rows = [(f, t) for f, t in TEMPLATES] + [(UNKNOWN, t) for t in NO_LICENCE]
    return docs.sparkSession.createDataFrame(rows, "family string, text string")


def template_grams(docs: DataFrame) -> DataFrame:
    """``family``, ``grams``: trigrams (all words where fewer than three) of each template."""
    known = with_terms(_templates(docs).where(F.col("family") != UNKNOWN))
    return known.select("family", F.array_distinct(_trigrams("words")).alias("grams"))


def _trigrams(words: str) -> Column:
    return F.when(F.size(words) >= 3, n_grams(words, 3)).otherwise(F.array(F.array_join(words, " ")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenceModel:
    """Fit on variants of the templates and on paragraphs of a bounded sample of documents.

    Odd variants and sampled paragraphs are held back; on them the probability
    of any licence is calibrated.  A sampled paragraph that shares a trigram
    with a template is no example of the unknown class.
    """
    words = F.split("text", " ")
    drop = F.filter(words, lambda w, i: F.pmod(F.xxhash64("variant", i, w), F.lit(100)) >= F.when(F.col("variant") < 2, 0).otherwise(DROPPED))
    made = _templates(docs).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    made = made.select("family", "variant", F.array_join(drop, " ").alias("text"))
    sample = bounded_sample(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")), UNKNOWN_DOCUMENTS, ["id", "text"])
    plain = with_terms(sample.select(F.explode(paragraphs(F.col("text"))).alias("text")))
    listed = [r["grams"] for r in template_grams(docs).collect()]
    known = sorted({g for grams in listed for g in grams})
    plain = plain.where(~F.arrays_overlap(_trigrams("words"), F.array(*[F.lit(g) for g in known])))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("variant"), "text")
    rows = written(with_terms(made.unionByName(plain)), "licence-training")

    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    index = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = rows.withColumn("label", index.cast("double"))
    fitted, held = rows.where("variant % 2 = 0"), rows.where("variant % 2 = 1")
    vectors = CountVectorizer(inputCol="terms", outputCol="features", binary=True, vocabSize=1 << 14, minDF=2).fit(fitted)
    classifier = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(vectors.transform(fitted))
    scored = _odds(classifier.transform(vectors.transform(held)))
    one = VectorAssembler(inputCols=["odds"], outputCol="place").transform(scored.withColumn("licence", (F.col("label") > 0).cast("double")))
    calibrator = LogisticRegression(featuresCol="place", labelCol="licence", probabilityCol="known", regParam=1e-2).fit(one.select("place", "licence"))
    return LicenceModel(vectors, classifier, calibrator, families)


def _odds(scored: DataFrame) -> DataFrame:
    """Adds ``chances`` (array) and ``odds``, the logarithm of licence against unknown."""
    scored = scored.withColumn("chances", vector_to_array("probability"))
    unknown = F.least(F.greatest(F.element_at("chances", 1), F.lit(1e-9)), F.lit(1 - 1e-9))
    return scored.withColumn("odds", F.log((1 - unknown) / unknown))


def classify(rows: DataFrame, model: LicenceModel, columns: Sequence[str]) -> DataFrame:
    """``columns`` with ``family``, ``probability`` and ``confirmed`` of each row's ``text``.

    The family is the likeliest licence where the calibrated probability of any
    licence is one half or more, else unknown.
    """
    scored = _odds(model.classifier.transform(model.vectors.transform(with_terms(rows))))
    slope, shift = float(model.calibrator.coefficients[0]), float(model.calibrator.intercept)
    probability = 1 / (1 + F.exp(-(F.lit(slope) * F.col("odds") + F.lit(shift))))
    licences = F.slice("chances", 2, len(model.families) - 1)
    likeliest = F.array_position(licences, F.array_max(licences)).cast("int")
    family = F.when(probability >= 0.5, F.element_at(F.array(*[F.lit(f) for f in model.families[1:]]), likeliest)).otherwise(F.lit(UNKNOWN))
    scored = scored.select(*columns, "words", probability.alias("probability"), family.alias("family"))
    # the templates' trigrams are a few hundred fixed strings
    grams = F.array(*[F.struct(F.lit(r["family"]).alias("family"), F.array(*[F.lit(g) for g in r["grams"]]).alias("grams")) for r in template_grams(rows).collect()])
    own = F.array_distinct(_trigrams("words"))
    shares = F.transform(
        F.filter(grams, lambda t: t["family"] == F.col("family")),
        lambda t: F.size(F.array_intersect(own, t["grams"])) / F.least(F.size(own), F.size(t["grams"])),
    )
    confirmed = F.when(F.col("family") != UNKNOWN, F.coalesce(F.array_max(shares) >= CONFIRM, F.lit(False))).otherwise(F.lit(False))
    return scored.withColumn("confirmed", confirmed).drop("words")


def scan_licences(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_paragraphs, n_confirmed, n_unconfirmed, licences, probability``.

    ``licences`` names the confirmed families in order; ``probability`` is the
    highest calibrated one of a confirmed paragraph, 0 where there is none.
    Null and empty texts have no paragraphs.  Repeated rows and null ids keep
    rows of their own.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("whole"))
    lines = numbered.select("row", "doc_id", F.explode_outer(paragraphs(F.col("whole"))).alias("line"))
    rows = lines.withColumn("text", F.coalesce("line", F.lit(""))).withColumn("given", F.col("line").isNotNull().cast("long")).drop("line")
    found = classify(rows, model, ["row", "doc_id", "given"])
    sure = (F.col("given") == 1) & F.col("confirmed")
    # a document's paragraphs leave the scan side by side and are merged before the shuffle
    out = found.groupBy("row", "doc_id").agg(
        F.sum("given").alias("n_paragraphs"), F.sum(sure.cast("long")).alias("n_confirmed"),
        F.sum(((F.col("given") == 1) & ~F.col("confirmed") & (F.col("family") != UNKNOWN)).cast("long")).alias("n_unconfirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("family")))), ",").alias("licences"),
        F.max(F.when(sure, F.col("probability")).otherwise(F.lit(0.0))).alias("probability"),
    )
    return out.drop("row")
