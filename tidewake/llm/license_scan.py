"""Licence scans by a trained paragraph classifier.

Units are the lines of a text and its blocks of several lines: all between blank lines, or the whole text if it has none.
Of a block over WINDOW lines each WINDOW lines are units too, half overlapping, and so are each WINDOW / 2, so that a wrapped
notice isn't lost in a long text.  A multinomial logistic regression with an L1 penalty over word 1- and 2-grams tells the licence families, `other`
(notices of families that have no name here) and `none`; it is trained on variations of the notices below, on phrases made
of the licences' names, and on units of a bounded sample of the corpus.  Its scores are tempered on variations that training
doesn't see, and on these the least probability of a family is chosen so that PRECISION of what is told is right; units
below it, `other` ones, and those in which neither a notice of the predicted family nor one of its names is contained are
unknown.  Every feature has a template word that is no stop word, so units without one score as `none` by the intercepts
alone and needn't be scored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import inline_rows, table

#: Family -> notices, fixed values.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Licensed under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This work is licensed under the GNU General Public License, version 3."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "Released under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "public-domain": ["This is free and unencumbered software released into the public domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}
#: Further notices.
MORE = {
    "apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"],
    "bsd": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit"],
    "cc-by-nc": ["You may not use the material for commercial purposes and you must give appropriate credit, Attribution-NonCommercial"],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original, Attribution-ShareAlike"],
    "gpl": ["You should have received a copy of the GNU General Public License along with this program", "Use of this source code is governed by the GNU General Public License version 2 or later"],
    "lgpl": ["You should have received a copy of the GNU Lesser General Public License along with this library", "This file is part of a library licensed under the GNU Lesser General Public License"],
    "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program"],
    "mit": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "proprietary": ["This software is the confidential and proprietary information of the company. You shall not disclose such confidential information"],
    "public-domain": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose", "This work has been dedicated to the public domain"],
}
#: Names that follow 'licensed under the' and the like.
NAMES = {
    "agpl": ["GNU AGPL", "AGPL-3.0", "AGPLv3", "AGPL-3.0-or-later", "Affero GPL", "Affero General Public License"],
    "apache": ["Apache License 2.0", "Apache-2.0", "Apache Software License", "Apache License, Version 2.0", "Apache 2.0", "Apache License"],
    "bsd": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "modified BSD license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC-BY-3.0", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC-BY-NC-3.0", "Creative Commons Attribution-NonCommercial 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0"],
    "gpl": ["GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later", "GPL version 2", "GNU General Public License version 2", "GPL"],
    "lgpl": ["GNU LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0-or-later", "LGPL version 2.1", "GNU Lesser General Public License", "Lesser General Public License", "LGPL"],
    "mit": ["MIT License", "MIT", "X11 MIT license", "Expat license", "MIT style license"],
    "mpl": ["Mozilla Public License", "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "MPL"],
    "public-domain": ["Unlicense", "CC0 1.0", "CC0-1.0", "CC0 public domain dedication", "public domain"],
}
#: Notices of families that are told as unknown, and their names.
OTHER_NOTICES = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "This Font Software is licensed under the SIL Open Font License", "The use of this software is governed by the end user license agreement that you accepted", "You may use this software for evaluation only under the terms of the sample license agreement"]
OTHER_NAMES = ["ISC License", "zlib License", "Boost Software License 1.0", "BSL-1.0", "Eclipse Public License 2.0", "EPL-2.0", "CDDL-1.0", "Common Development and Distribution License", "Artistic License 2.0", "EUPL-1.2", "European Union Public Licence", "OFL-1.1", "WTFPL", "PostgreSQL License", "Python Software Foundation License", "Microsoft Public License", "SSPL-1.0", "Server Side Public License", "Business Source License 1.1", "JSON License"]
PHRASES = ["Licensed under the {}", "Released under the {}.", "This file is distributed under the terms of the {}", "SPDX-License-Identifier: {}", "License: {}", "This project is licensed under {}, see the LICENSE file for details", "The code is available under the {}", "Published under {}", "This package may be used under the terms of the {} or any later version", "Dual licensed under {}", "Its content is licensed {} unless noted"]
#: Words of which one stands next to a name.
CUES = frozenset("license licensed licenses released distributed terms spdx identifier under governed dedicated".split())
#: Sentences with licence words that are no licences.
ORDINARY = [
    "He studied at MIT and then moved to the coast", "The public domain of the town was sold", "The affero ferry left at nine", "You need a fishing license from the office", "Her driver license expired in May",
    "The apache helicopter was released from the hangar under guard", "The general public was told to stay at home", "Their rights to the land were reserved for the children", "The terms under which it was sold are secret",
    "License plates are issued at the counter", "The committee granted permission to build the bridge", "Distribution of the goods was under the control of the army", "The software was released last week", "Our library is open under new terms",
    "She renewed her driving license at the public office last week", "Human rights were the subject of the work", "A free copy of the map is on the table", "The software was late and the version was wrong",
    "The terms of the loan are due in May", "Permission to land was granted to the pilot", "Any person may use the library", "The source of the river is in the hills", "He modified the form and returned it by post",
    "Apache is the name of several peoples", "The general reserved two rooms for later use", "Creative work needs time and commons need care", "International distribution of the file stopped", "The mozilla is not a kind of domain",
]
STOP = frozenset("a an and any are as at be by for from in is it its of on one or than that the this to under was were with you your not if may no all".split())
#: Documents whose units serve as examples of `none`, expected, and these units at most; the part of a notice that a family needs.
NEGATIVE_DOCS, NEGATIVE_UNITS, CONTAINED = 400, 8000, 0.7
#: Part of the families told that shall be right; the least probabilities among which that is sought.
PRECISION, LEVELS = 0.99, [i / 20 for i in range(5, 20)]
#: Lines of a unit in a long block; wrapped notices of up to WINDOW / 2 + 1 lines are whole in one of them.
WINDOW = 8
NONE, OTHER = "none", "other"
CLASSES = [NONE, *TEMPLATES, OTHER]


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower().replace("licenc", "licens"))


def _grams(words: list[str]) -> list[str]:
    return [g for g in [*words, *map(" ".join, zip(words, words[1:], strict=False))] if not STOP.issuperset(g.split())]


NOTICES = {k: [*v, *MORE.get(k, [])] for k, v in TEMPLATES.items()}
_SOURCES = [*(t for ts in NOTICES.values() for t in ts), *OTHER_NOTICES, *(n for ns in [*NAMES.values(), OTHER_NAMES] for n in ns), *PHRASES]
VOCABULARY = sorted({g for t in _SOURCES for g in _grams(_tokens(t))})
KEYS = sorted({g for g in VOCABULARY if " " not in g})


def words(text: Column) -> Column:
    return F.filter(_split(text), lambda w: w != "")


def _split(text: Column) -> Column:
    return F.split(F.replace(F.lower(text), F.lit("licenc"), F.lit("licens")), "[^a-z0-9]+", -1)


def _features(w: Column) -> Column:
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def _contained(w: Column, family: Column) -> Column:
    """The largest part of a notice of the family that the words have, 1 for a name of it beside a cue; 0 for other classes."""
    out = F.lit(0.0)
    some = lambda words: F.array(*map(F.lit, sorted(words)))
    cue = F.arrays_overlap(w, some(CUES))
    for name, texts in NOTICES.items():
        parts = [F.size(F.array_intersect(w, some(set(_tokens(t))))) / len(set(_tokens(t))) for t in texts]
        if name in NAMES:
            row = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
            named = [row.contains(f" {' '.join(_tokens(n))} ") for n in NAMES[name]]
            parts.append(F.when(cue & reduce(or_, named), 1.0).otherwise(0.0))
        out = F.when(family == name, F.greatest(*parts)).otherwise(out)
    return out


def examples() -> list[dict]:
    """Variations of the notices and names: whole, without every k-th word, cut, and between ordinary words; fold 1 is for calibration."""
    rows, fill = [], [t for s in ORDINARY for t in _tokens(s)]

    def add(label: str, variants: list[list[str]], at: int = 0) -> None:
        rows.extend({"label": label, "text": " ".join(x), "fold": int((i + at) % 4 == 3)} for i, x in enumerate(variants))

    for label, texts in [*NOTICES.items(), (OTHER, OTHER_NOTICES)]:
        for text in texts:
            t = _tokens(text)
            some = [t, t]
            some += [[x for i, x in enumerate(t) if i % k != r] for k in (4, 5, 7) for r in range(k)] if len(t) > 6 else []
            some += [fill[i : i + n] + t + fill[i + 40 : i + 40 + m] for i, (n, m) in enumerate([(3, 0), (0, 5), (4, 4), (8, 2), (2, 9), (12, 12), (30, 35), (0, 60), (60, 5), (40, 40)])]
            add(label, some)
    for label, names in [*NAMES.items(), (OTHER, OTHER_NAMES)]:
        for k, name in enumerate(names):
            made = [_tokens(p.format(name)) for p in PHRASES]
            add(label, [x for i, t in enumerate(made) for x in (t, fill[i * 7 : i * 7 + 4] + t + fill[i * 5 + 60 : i * 5 + 63])], k)
    for i, s in enumerate(ORDINARY):
        t = _tokens(s)
        add(NONE, [t, t[::-1], t[: len(t) // 2], fill[i * 5 : i * 5 + 15]], i)
    return rows


def units(text: Column) -> Column:
    """array<struct<block, wide, text>>: the lines of the text that have a key word, its blocks of several lines and, of long ones, windows, each with such a line.

    Blank lines are left out.  A line's words are looked at once: what is made of lines has a key word if one of them has."""
    line = lambda x: F.struct(x.alias("text"), _is_key(_split(x)).alias("key"))
    full = lambda x: F.trim(x) != ""
    blocks = F.transform(F.filter(F.split(text, r"\n[\x20\x09\x0D]*\n", -1), full), lambda x: F.transform(F.filter(F.split(x, "\n", -1), full), line))

    def cut(lines: Column, n: Column) -> Column:  # lines: a lambda's variable, so they are split once only
        made = lambda wide, x: F.struct(n.alias("block"), F.lit(wide).alias("wide"), x.alias("text"))
        keyed = lambda part: F.exists(part, lambda x: x["key"])
        joined = lambda part: made(True, F.array_join(part["text"], "\n"))

        def windows(n: int) -> Column:
            steps = F.when(F.size(lines) > n, F.sequence(F.lit(1), F.size(lines) - n // 2, F.lit(n // 2))).otherwise(F.array().cast("array<int>"))
            return F.transform(F.filter(steps, lambda i: keyed(F.slice(lines, i, n))), lambda i: joined(F.slice(lines, i, n)))

        whole = F.transform(F.filter(F.array(F.lit(1)), lambda _: F.size(lines) > 1), lambda _: joined(lines))
        found = F.concat(F.transform(F.filter(lines, lambda x: x["key"]), lambda x: made(False, x["text"])), whole, windows(WINDOW // 2), windows(WINDOW))
        return F.when(keyed(lines), found).otherwise(F.expr("cast(array() as array<struct<block:int,wide:boolean,text:string>>)"))

    return F.flatten(F.transform(blocks, cut))


def _is_key(w: Column) -> Column:
    return F.arrays_overlap(w, F.array(*map(F.lit, KEYS)))


class Model:
    def __init__(self, cells, regression, temperature: float, least: float = 0.5):
        self.cells, self.regression, self.temperature, self.least = cells, regression, temperature, least

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with `words` -> with family (`none` if that is the likeliest or none is likely enough), likely and probability."""
        return self.told(self.regression.transform(self.cells.transform(rows.withColumn("grams", _features(F.col("words"))))))

    def told(self, out: DataFrame) -> DataFrame:
        raw = F.transform(vector_to_array("raw"), lambda x: x / F.lit(self.temperature))
        out = out.withColumn("e", F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))).withColumn("probability", F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        names = F.array(*map(F.lit, CLASSES))
        likely = F.get(names, (F.array_position("e", F.array_max("e")) - 1).cast("int"))
        return out.withColumn("likely", likely).drop("grams", "cells", "raw", "e", "p", "guess")


def train(docs: DataFrame) -> Model:
    """docs: text."""
    spark = docs.sparkSession
    code = {k: i for i, k in enumerate(CLASSES)}
    made = inline_rows(spark, [{"y": float(code[r["label"]]), "text": r["text"], "fold": r["fold"]} for r in examples()], "y double, text string, fold int")
    n = max(1, docs.count())
    spot = F.pmod(F.xxhash64(F.lit("none"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    other = docs.where("text is not null").where(spot < NEGATIVE_DOCS / n).select(F.explode(units(F.col("text"))["text"]).alias("text"))
    found = F.greatest(*[_contained(words(F.col("text")), F.lit(f)) for f in TEMPLATES])
    other = other.where(found < CONTAINED / 2).select(F.lit(0.0).alias("y"), "text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 3).cast("int").alias("fold"))
    other = other.orderBy(F.xxhash64("text"), "text").limit(NEGATIVE_UNITS)  # of a sample of the documents, a documented bound
    cells = CountVectorizerModel.from_vocabulary(VOCABULARY, "grams", "cells").setBinary(True)
    data = cells.transform(made.unionByName(other).coalesce(1).withColumn("grams", _features(words(F.col("text"))))).select("y", "fold", "cells").persist()
    fit = LogisticRegression(featuresCol="cells", labelCol="y", rawPredictionCol="raw", probabilityCol="p", predictionCol="guess", family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=60, standardization=False)
    regression = fit.fit(data.where("fold = 0"))
    held = regression.transform(data.where("fold = 1")).select("y", vector_to_array("raw").alias("raw"))
    grid = [2.0 ** (k / 2) for k in range(-6, 7)]

    def loss(t: float) -> Column:
        top = F.array_max("raw") / t
        total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x / t - top))
        return F.avg(F.log(total) + top - F.get("raw", F.col("y").cast("int")) / t)

    losses = held.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    best = min((x if x is not None else float("inf"), abs(grid[i] - 1), grid[i]) for i, x in enumerate(losses))
    model = Model(cells, regression, best[2])
    held = model.told(regression.transform(data.where("fold = 1"))).where(~F.col("likely").isin(NONE, OTHER))
    right = F.col("likely") == F.get(F.array(*map(F.lit, CLASSES)), F.col("y").cast("int"))
    rates = held.agg(*[F.avg(F.when(F.col("probability") >= p, right.cast("double"))).alias(f"p{i}") for i, p in enumerate(LEVELS)]).first()
    model.least = next((p for p, x in zip(LEVELS, rates, strict=True) if x is not None and x >= PRECISION), LEVELS[-1])
    data.unpersist()
    return model


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, families (sorted), n_units (confirmed lines, and families of blocks that none of their lines has), n_unknown (licence-like lines of no known family, and such blocks without a licence-like line), evidence (array<struct<unit, family, probability, contained>>).

    A null, empty or blank text has no units.  Rows don't depend on each other, so repeated rows and ids do no harm; other
    columns of docs aren't looked at.  Long texts are cut in units, never short.  Of equally likely families the first by
    name is told; a notice that names two licences is told as the likelier.  A table without rows gives none.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("rid", F.monotonically_increasing_id())
    some = F.when(_is_key(_split(F.col("text"))), units(F.col("text")))
    flat = rows.select("rid", "doc_id", F.posexplode_outer(some).alias("unit", "u")).select("rid", "doc_id", "unit", "u.*").withColumn("words", F.coalesce(words(F.col("text")), F.array().cast("array<string>")))
    told = model.score(flat).withColumn("contained", _contained(F.col("words"), F.col("likely")))
    is_licence = F.col("text").isNotNull() & (F.col("likely") != NONE)
    sure = is_licence & (F.col("likely") != OTHER) & (F.col("probability") >= model.least) & (F.col("contained") >= CONTAINED)
    seen = F.when(is_licence, F.struct("unit", F.when(sure, F.col("likely")).otherwise(F.lit("unknown")).alias("family"), "probability", "contained"))
    of = lambda test, x: F.collect_set(F.when(test, x))
    place = F.struct("block", "likely")
    line, wide = ~F.col("wide"), F.col("wide")
    blocks = F.size(F.array_except(of(sure & wide, place), of(sure & line, place)))
    vague = F.size(F.array_except(of(is_licence & ~sure & wide, F.col("block")), of(is_licence & (line | sure), F.col("block"))))
    n_units, n_unknown = F.count_if(sure & line) + blocks, F.count_if(is_licence & ~sure & line) + vague
    out = told.groupBy("rid", "doc_id").agg(F.array_sort(of(sure, F.col("likely"))).alias("families"), n_units.alias("n_units"), n_unknown.alias("n_unknown"), F.array_sort(F.collect_list(seen)).alias("evidence"))
    return out.drop("rid")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs.select("text"))).select("doc_id", F.array_join("families", ",").alias("families"), "n_units", "n_unknown")
