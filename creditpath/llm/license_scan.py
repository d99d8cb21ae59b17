"""License scans by a trained paragraph classifier.

Word n-grams of known notices are the features of a logistic regression that tells
license families and an unknown class apart. Its threshold is calibrated on paragraphs
it has not seen. A predicted family is confirmed when the paragraph holds enough of the
word pairs of one of the family's notices. A paragraph is a line, or a bounded window of
words over the lines between two wordless ones that holds enough of a notice. Each
license of an SPDX expression is a paragraph of its own. The unknown class is learned
from other paragraphs, and from notices without their license's name or with a "not".
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import literal_array, lower_ascii, stash, sum_at, words_between

# Short public notices of each family.
NOTICES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY 4.0.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Identifiers of each family in SPDX expressions.
SPDX = {
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache": ["Apache-2.0"],
    "bsd": ["0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"],
    "cc-by": ["CC-BY-3.0", "CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"],
    "cc0": ["CC0-1.0"],
    "epl": ["EPL-1.0", "EPL-2.0"],
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mit": ["MIT"],
    "mpl": ["MPL-2.0"],
    "unlicense": ["Unlicense"],
}
SPDX_TAG = "SPDX-License-Identifier:"
for _family, _ids in SPDX.items():
    NOTICES[_family] += [f"{SPDX_TAG} {i}" for i in _ids]
# Words that name a license; a notice with some of them is confirmed by at least one only.
NAMES = {
    "affero", "apache", "bsd", "bsd-style", "cc", "cc0", "commons", "eclipse", "gnu", "isc", "lesser", "mit", "mozilla",
}
# Words whose negation makes a notice say the opposite, and the words before a notice that are read for it.
CONTEXT = 3
NEGATED = {"governed", "granted", "licensed", "permitted", "released"}
SEPARATORS = r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+"
# Share of unseen unknown paragraphs that may pass the threshold, and of a notice's word pairs that confirm it.
FALSE_POSITIVES, CONFIRMED = 0.001, 0.6
RIDGE, STEPS = 0.0001, 100
# The threshold is a multiple of one by this number.
THRESHOLDS = 10_000


def notice_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in re.split(r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def anchors_of(notices: dict[str, list[str]], share: float) -> list[str]:
    """Words of which every paragraph has one that holds at least ``share`` of a notice's word pairs.

    For each notice its longest words, until the pairs without any of them are too few.
    """
    found: set[str] = set()
    for text in (t for texts in notices.values() for t in texts):
        words = notice_words(text)
        pairs = {tuple(p.split(" ")) for p in pairs_of(words)}
        needed = math.ceil(share * len(pairs))
        chosen: set[str] = set()
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(not chosen & set(p) for p in pairs) < needed:
                break
            chosen.add(word)
        found |= chosen
    return sorted(found)


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    each = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, each).otherwise(F.expr("array()").cast("array<string>"))


def _with_pairs(lines: DataFrame) -> DataFrame:
    """``lines`` (line) with words and word pairs."""
    return lines.withColumn("words", words_between(lower_ascii(F.col("line")), SEPARATORS)).withColumn(
        "pairs", _pairs(F.col("words"))
    )


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _where_notice(family: str, text: str, share: float) -> Column:
    """The places in ``words`` (word, at) where a notice begins whose word pairs are there by ``share``, over line ends too.

    A struct (paragraph, last, start, end, line) each: first and last line, first and last
    word, and the words with some before them. A place has no wordless line inside, and no
    other one of the same notice begins in it. ``_pairs`` are the pairs of ``words``, empty over
    a wordless line; ``_hits`` are the places (from 1) of pairs of any notice.
    """
    wanted = sorted(set(pairs_of(notice_words(text))))
    known, length = literal_array(wanted, "string"), len(wanted)
    needed, window = math.ceil(share * length), length + math.ceil(length / 4)

    def ahead(pairs: Column, p: Column) -> Column:
        near = F.slice(pairs, p, window)
        return F.when(F.array_contains(near, ""), F.slice(near, 1, F.greatest(F.array_position(near, "") - 1, F.lit(0)).cast("int"))).otherwise(near)

    def start(pairs: Column, p: Column) -> Column:
        """How many pairs the window shares, and how many pairs it takes from ``p`` until all of them were there."""

        def measured(near: Column) -> Column:
            shared = F.array_intersect(near, known)
            reach = F.array_max(F.transform(shared, lambda x: F.array_position(near, x))).cast("int")
            return F.struct(F.size(shared).alias("n"), (-reach).alias("reach"), (-p).alias("p"))

        return _let(ahead(pairs, p), measured)

    def starts(pairs: Column) -> Column:
        here = F.filter("_hits", lambda p: F.array_contains(known, F.get(pairs, p - 1)))
        return F.filter(F.transform(here, lambda p: start(pairs, p)), lambda x: x["n"] >= needed)

    def first(found: Column) -> Column:
        """Of the places within a notice's length, it begins where most pairs are shared, in the least space."""
        numbered = F.transform(found, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i")))
        return F.aggregate(
            numbered,
            F.filter(found, lambda x: F.lit(False)),
            lambda seen, x: F.when(
                F.coalesce(F.get(seen, F.size(seen) - 1)["p"] - x["p"] >= length, F.lit(True)),
                F.concat(
                    seen,
                    # Starts are at different places, so those within a length are among the next ``length`` ones.
                    F.array(F.array_max(F.filter(F.slice(found, x["i"] + 1, length), lambda y: y["p"] > x["p"] - length))),
                ),
            ).otherwise(seen),
        )

    def place(words: Column, pairs: Column, x: Column) -> Column:
        p, held = -x["p"], -x["reach"] - 1
        before = F.least(p - 1, F.lit(CONTEXT))
        before = F.when(F.array_contains(F.slice(pairs, p - before, before), ""), 0).otherwise(before)
        return F.struct(
            F.get(words, p - 1)["at"].alias("paragraph"),
            F.get(words, p + held)["at"].alias("last"),
            p.alias("start"),
            (p + held + 1).alias("end"),
            F.array_join(F.transform(F.slice(words, p - before, held + 2 + before), lambda w: w["word"]), " ").alias("line"),
        )

    # Arrays as built by an expression are sliced in the time of the slice, arrays of a row in that of the array.
    every = _let(
        F.transform("_pairs", lambda x: x),
        lambda pairs: _let(
            F.transform("words", lambda w: w),
            lambda words: F.transform(_let(starts(pairs), first), lambda x: place(words, pairs, x)),
        ),
    )
    enough = F.size(F.array_intersect("_known", known)) >= needed
    return F.when(enough, every).otherwise(F.expr("array()").cast(PLACES))


PLACES = "array<struct<paragraph:int,last:int,start:int,end:int,line:string>>"


def _licenses_of(line: Column) -> Column:
    """The line, or a line for each license of the SPDX expression in it."""
    tag = f"(?i){SPDX_TAG}"
    terms = F.split(F.regexp_replace(F.regexp_extract(line["line"], tag + r"\s*(.*)", 1), r"(?i)\s+WITH\s+[^\s)]+", ""), r"(?i)\s+(?:OR|AND)\s+")
    each = F.transform(terms, lambda t: line.withField("line", F.concat(F.lit(SPDX_TAG + " "), F.regexp_replace(t, "[()]", ""))))
    return F.when(F.rlike(line["line"], F.lit(tag)), each).otherwise(F.array(line))


def paragraphs(documents: DataFrame, notices: dict[str, list[str]] = NOTICES, share: float = CONFIRMED) -> DataFrame:
    """(doc_id, _text, _row, paragraph, last, start, end, line): what may be a notice.

    These are the lines that have an anchor word of some notice, with start and end NULL,
    and the places, in one line or wrapped over several, that hold enough of a notice.
    Nothing else can be confirmed. One row of each document, with ``_row`` true, is
    there in any case; without a line its other columns are NULL.
    """
    anchor = F.lit("(?i:" + "|".join(re.escape(w) for w in anchors_of(notices, share)) + ")")
    none = F.lit(None).cast("int")
    # A "not" among the last words of the line before belongs to the line.
    denial = rf"(?i)(\bnot(?:\s+\w+){{0,{CONTEXT - 1}}})\W*$"

    def told(every: Column, line: Column, i: Column) -> Column:
        above = F.regexp_extract(F.coalesce(F.get(every, i - 1), F.lit("")), denial, 1)
        return F.when(F.rlike(line, anchor) & (above != ""), F.concat_ws(" ", above, line)).otherwise(line)

    def numbered(every: Column) -> Column:
        return F.transform(
            every,
            lambda line, i: F.struct(
                i.alias("paragraph"), i.alias("last"), none.alias("start"), none.alias("end"), told(every, line, i).alias("line")
            ),
        )

    lines = _let(F.split("text", "\n"), numbered)
    found = F.rlike("text", anchor)
    lines = F.flatten(F.transform(lines, _licenses_of))
    lines = F.when(found, F.filter(lines, lambda x: F.rlike(x["line"], anchor))).cast(PLACES)
    # A notice of one pair is in one line.
    texts = [(family, text) for family in sorted(notices) for text in notices[family]]
    wrapped = [(family, text) for family, text in texts if len(notice_words(text)) > 2]
    every = literal_array(sorted({p for _, text in texts for p in pairs_of(notice_words(text))}), "string")
    rows = documents.select("doc_id", F.xxhash64("text").alias("_text"), "text", lines.alias("lines"), found.alias("_found"))
    flat = F.when(F.col("_found"), words_between(lower_ascii(F.col("text")), SEPARATORS))
    rows = rows.withColumn("_flat", flat).withColumn("_known", F.array_intersect(_pairs(F.col("_flat")), every))
    enough = F.lit(False)
    for _, text in wrapped:
        wanted = sorted(set(pairs_of(notice_words(text))))
        enough = enough | (F.size(F.array_intersect("_known", literal_array(wanted, "string"))) >= math.ceil(share * len(wanted)))
    # A word pair over a wordless line is none: the lines of its words are not neighbours.
    words = F.transform(
        F.split(lower_ascii(F.col("text")), "\n"),
        lambda line, i: F.transform(words_between(line, SEPARATORS), lambda w: F.struct(w.alias("word"), i.alias("at"))),
    )
    rows = rows.withColumn("words", F.when(enough, F.flatten(words)))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    each = F.zip_with(
        F.slice("words", 1, n),
        F.slice("words", 2, n),
        lambda a, b: F.when(b["at"] - a["at"] < 2, F.concat_ws(" ", a["word"], b["word"])).otherwise(""),
    )
    rows = rows.withColumn("_pairs", F.when(n > 0, each))
    numbers = F.when(F.col("_pairs").isNotNull(), F.sequence(F.lit(1), F.size("_pairs")))
    rows = rows.withColumn("_hits", F.filter(numbers, lambda p: F.array_contains(every, F.get("_pairs", p - 1))))
    places = F.flatten(F.array(*[_where_notice(family, text, share) for family, text in wrapped]))
    both = F.when(F.col("_pairs").isNotNull(), F.concat("lines", places)).otherwise(F.col("lines"))
    rows = rows.select("doc_id", "_text", F.posexplode_outer(both).alias("_at", "_line"))
    return rows.select("doc_id", "_text", (F.coalesce("_at", F.lit(0)) == 0).alias("_row"), "_line.*")


def _once(found: Column, families: list[str]) -> Column:
    """Of the notices of a document, each one once, in order.

    A place is left out when a line in it is a notice of the same family by itself, or when
    a place of the same family before it reaches into it.
    """
    none = F.filter(found, lambda x: F.lit(False))

    def of_family(mine: Column) -> Column:
        # From the last line to the first, so that the next line with a notice is known at each place.
        backward = F.array_sort(
            mine, lambda x, y: F.when(x["paragraph"] != y["paragraph"], y["paragraph"] - x["paragraph"]).otherwise(
                F.coalesce(x["start"], F.lit(0)) - F.coalesce(y["start"], F.lit(0))
            ),
        )
        apart = F.aggregate(
            backward,
            F.struct(F.lit(None).cast("int").alias("line"), none.alias("kept")),
            lambda seen, x: F.when(x["start"].isNull(), F.struct(x["paragraph"].alias("line"), F.concat(seen["kept"], F.array(x)).alias("kept")))
            .when(seen["line"] <= x["last"], seen)
            .otherwise(F.struct(seen["line"].alias("line"), F.concat(seen["kept"], F.array(x)).alias("kept"))),
            lambda seen: seen["kept"],
        )
        return F.aggregate(
            F.array_sort(apart, lambda x, y: F.coalesce(x["start"], F.lit(0)) - F.coalesce(y["start"], F.lit(0))),
            F.struct(F.lit(-1).alias("upto"), none.alias("kept")),
            lambda seen, x: F.when(x["start"] <= seen["upto"], seen).otherwise(
                F.struct(F.coalesce(x["end"], seen["upto"]).alias("upto"), F.concat(seen["kept"], F.array(x)).alias("kept"))
            ),
            lambda seen: seen["kept"],
        )

    present = F.filter(literal_array(families, "string"), lambda f: F.exists(found, lambda x: x["family"] == f))
    kept = F.flatten(F.transform(present, lambda f: _let(F.filter(found, lambda x: x["family"] == f), of_family)))
    plain = F.transform(kept, lambda x: F.struct(x["paragraph"], x["family"], x["probability"]))
    return F.array_sort(plain).cast("array<struct<paragraph:int,family:string,probability:double>>")


@dataclass
class LicenseModel:
    """Families, vocabulary, [word n-gram, class] weights with the intercept last, least probability.

    Class 0 is unknown, class i is family i - 1.
    """

    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    least: float = 0.5

    def features(self) -> Column:
        """The places (from 0) of a line's n-grams in the vocabulary."""
        known = literal_array(self.vocabulary, "string")
        seen = F.array_intersect(F.concat("words", "pairs"), known)
        return F.transform(seen, lambda g: F.array_position(known, g).cast("int") - 1)

    def scored(self, lines: DataFrame) -> DataFrame:
        """``lines`` (at: the places of the n-grams) with family and probability of the likeliest known family."""
        logits = [sum_at(F.col("at"), column.tolist(), float(column[-1])) for column in self.weights.T]
        rows = lines.withColumn("_logits", F.array(*logits))
        rows = rows.withColumn("_top", F.array_max("_logits"))
        rows = rows.withColumn("_parts", F.transform("_logits", lambda z: F.exp(z - F.col("_top"))))
        known = F.slice("_parts", 2, len(self.families))
        total = F.aggregate("_parts", F.lit(0.0), lambda seen, x: seen + x)
        place = F.array_position(known, F.array_max(known)).cast("int") - 1
        rows = rows.withColumns(
            {"family": F.get(literal_array(self.families, "string"), place), "probability": F.array_max(known) / total}
        )
        return rows.drop("_logits", "_top", "_parts")


def _examples(notices: dict[str, list[str]], families: list[str]) -> list[tuple[int, float, list[str]]]:
    """(class, weight, n-grams) of every run of at least two thirds of a notice's words; every notice weighs 1."""
    found = []
    for family, texts in notices.items():
        for text in texts:
            words = notice_words(text)
            sizes = range(max(2, math.ceil(len(words) * 2 / 3)), len(words) + 1)
            parts = [words[at : at + size] for size in sizes for at in range(len(words) - size + 1)]
            found += [(families.index(family) + 1, 1 / len(parts), [*part, *pairs_of(part)]) for part in parts]
    return found


def _not_notices(notices: dict[str, list[str]]) -> list[list[str]]:
    """n-grams of every notice that names its license with another name in its place, and of every negated notice."""
    found = []
    for text in (t for texts in notices.values() for t in texts):
        words = notice_words(text)
        if NAMES & set(words):
            pairs = [f"{a} {b}" for a, b in zip(words, words[1:]) if not {a, b} & NAMES]
            found.append([*(w for w in words if w not in NAMES), *pairs])
        for at in (i for i, w in enumerate(words) if w in NEGATED):
            part = [*words[:at], "not", *words[at:]]
            grams = [[*x, *pairs_of(x)] for x in (part, part[max(at - 1, 0) :], part[at:])]
            found += [[g for g in each if g != "not"] for each in grams]
    return found


def vocabulary_of(notices: dict[str, list[str]]) -> list[str]:
    found = {g for _, _, grams in _examples(notices, sorted(notices)) for g in grams}
    return sorted(found.union(*_not_notices(notices)))


def candidates(documents: DataFrame, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """The rows of :func:`paragraphs` with ``at``, the places of their n-grams in the vocabulary, the families that
    ``could`` be confirmed, and of each line that holds no notice a ``plain`` hash.
    """
    vocabulary = vocabulary_of(notices)
    model = LicenseModel(sorted(notices), vocabulary, np.zeros(0))
    rows = _with_pairs(paragraphs(documents, notices))
    pairs = literal_array([g for g in vocabulary if " " in g], "string")
    tagged = F.rlike("line", F.lit(f"(?i){SPDX_TAG}"))
    plain = F.col("start").isNull() & (F.size(F.array_intersect("pairs", pairs)) < 2) & ~tagged
    at = F.coalesce(F.sort_array(model.features()), F.expr("array()").cast("array<int>"))
    return rows.withColumns(
        {"at": at, "could": could_be(notices), "plain": F.when(plain, F.xxhash64("line"))}
    ).drop("line", "words", "pairs")


def fit(found: DataFrame, notices: dict[str, list[str]] = NOTICES) -> LicenseModel:
    """Learn the families from the notices, and the unknown class from all lines of ``found`` that hold no notice.

    ``found`` are the candidates of all documents: no other line can be a notice. Equal lines
    count once. One half of the lines, by their hash, is learned from, each set of n-grams once;
    the other half calibrates the threshold. Only weights and counts by probability come to the driver.
    """
    spark = found.sparkSession
    families = sorted(notices)
    examples = _examples(notices, families)
    against = _not_notices(notices)
    vocabulary = vocabulary_of(notices)
    number = {g: i for i, g in enumerate(vocabulary)}
    lines = found.where("plain IS NOT NULL").select("plain", "at").dropDuplicates(["plain"])
    seen = stash(lines.groupBy(F.pmod("plain", F.lit(2)).alias("half"), "at").agg(F.count(F.lit(1)).alias("n")), "lines")
    learned = seen.where("half = 0 AND size(at) > 0").select("at")
    # A line without a known n-gram is unknown in any case. Lines weigh as much as changed notices, all classes the same.
    each = 1 / (learned.count() + 1)
    rows = [(0.0, each / 2, [])] + [(0.0, 1 / len(against) / 2, [number[g] for g in grams]) for grams in against]
    rows += [(float(c), weight / len(notices[families[c - 1]]), [number[g] for g in grams]) for c, weight, grams in examples]
    told = spark.createDataFrame(rows, "label double, weight double, at array<int>")
    told = told.unionByName(learned.select(F.lit(0.0).alias("label"), F.lit(each / 2).alias("weight"), "at"))
    names = [str(i) for i in range(len(vocabulary))]
    counter = CountVectorizerModel.from_vocabulary(names, "grams", "features")
    told = counter.transform(told.withColumn("grams", F.col("at").cast("array<string>")))
    fitted = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=RIDGE, standardization=False, maxIter=STEPS
    ).fit(told)
    weights = np.vstack([fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray()])
    model = LicenseModel(families, vocabulary, weights)
    step = F.floor(F.col("probability") * THRESHOLDS).cast("int")
    unseen = model.scored(seen.where("half = 1"))
    counts = dict(unseen.groupBy(F.greatest(step, F.lit(THRESHOLDS // 2 - 1)).alias("step")).agg(F.sum("n")).collect())
    allowed, least = FALSE_POSITIVES * sum(counts.values()), THRESHOLDS
    while least > THRESHOLDS // 2 and sum(n for at, n in counts.items() if at >= least - 1) <= allowed:
        least -= 1
    model.least = least / THRESHOLDS
    return model


def could_be(notices: dict[str, list[str]] = NOTICES, share: float = CONFIRMED) -> Column:
    """The families of which ``pairs`` hold at least ``share`` of the word pairs of a notice, and ``words`` a name in it."""
    found = []
    for family, texts in sorted(notices.items()):
        enough = F.lit(False)
        for text in texts:
            wanted = sorted(set(pairs_of(notice_words(text))))
            here = F.size(F.array_intersect("pairs", literal_array(wanted, "string"))) >= math.ceil(share * len(wanted))
            names = sorted(NAMES & set(notice_words(text)))
            enough = enough | (here & F.arrays_overlap("words", literal_array(names, "string")) if names else here)
        found.append(F.when(enough, F.lit(family)))
    return F.array_compact(F.array(*found))


def licenses(documents: DataFrame, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """doc_id, n_notices, families (sorted, comma-joined), notices for every row of ``documents`` (doc_id, text).

    notices lists, in order, paragraph (number of its first line, from 0), family and probability
    of each confirmed notice, which may be wrapped over lines up to a wordless one. A NULL or empty text has none; rows repeated in id and text
    are returned as often; a NULL doc_id is an id like any other; in an empty table the
    unknown class is learned from the empty line alone. Further columns are ignored.
    """
    every = stash(candidates(documents, notices), "candidates")
    model = fit(every, notices)
    scored = model.scored(every)
    sure = F.col("probability") >= model.least
    good = F.col("paragraph").isNotNull() & sure & F.expr("array_contains(could, family)")
    notice = F.when(good, F.struct("paragraph", "family", F.round("probability", 4).alias("probability"), "last", "start", "end"))
    per_doc = scored.groupBy("doc_id", "_text").agg(
        F.collect_set(notice).alias("_found"), F.sum(F.col("_row").cast("long")).alias("_rows")
    ).withColumn("notices", _once(F.col("_found"), sorted(notices)))
    found = per_doc.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",").alias("families"),
        "notices",
        F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy"),
    )
    return found.drop("_copy")
