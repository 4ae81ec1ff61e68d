"""Licence scan, with DataFrame functions only: a trained paragraph classifier, confirmed by templates.

Paragraphs end at blank lines; one of more than WINDOW words is read in windows that overlap. A sparse
multinomial logistic regression over words and pairs of words gives each of them, without any filter
before it, a licence family or the unknown class. Its features are the words and pairs of the sentences
below. It is fitted on declarations of each family, alone and inside other text, on the same
declarations denied or merely named, and on a bounded sample of the corpus. A
family's chance against the unknown class must reach a level calibrated on other wordings and other
windows, which were kept apart; several families of a window can. A comparison with the family's
templates confirms a prediction, the likeliest family's by most of a template, another's by a whole one.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.llm.common import row_key

#: Sentences by which texts declare a licence, or that licences consist of, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License 2.0",
        "Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GPL v3",
        "GPLv2",
        "GPL 3.0 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "LGPL 2.1",
        "LGPLv3",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "AGPLv3",
        "AGPL 3.0",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "BSD License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "isc": [
        "ISC License",
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License 2.0",
        "MPL 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Eclipse Public License",
        "EPL 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or later.",
        "European Union Public Licence",
        "EUPL 1.2",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "CC0 1.0 Universal",
        "The Unlicense",
    ],
    "zlib": [
        "zlib License",
        "SPDX-License-Identifier: Zlib",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "wtfpl": [
        "Do What The Fuck You Want To Public License",
        "WTFPL",
        "SPDX-License-Identifier: WTFPL",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "CC BY 3.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "CC BY-SA 3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "CC BY-NC 3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "CC BY-NC-SA 4.0",
    ],
}
#: Short names of families, the first of them the one that denials name; none begins a name of another family.
NAMES = {
    "mit": ["MIT License", "MIT"],
    "apache-2.0": ["Apache License", "Apache 2.0", "Apache"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GNU General Public License"],
    "lgpl": ["LGPL", "LGPLv2", "LGPLv3", "GNU Lesser General Public License"],
    "agpl": ["AGPL", "AGPLv3", "GNU Affero General Public License"],
    "bsd": ["BSD License", "BSD", "BSD 2 Clause", "BSD 3 Clause"],
    "isc": ["ISC License", "ISC"],
    "mpl": ["Mozilla Public License", "MPL", "MPL 2.0"],
    "epl": ["Eclipse Public License", "EPL", "EPL 2.0"],
    "eupl": ["EUPL", "EUPL 1.2"],
    "public-domain": ["Unlicense", "CC0"],
    "zlib": ["zlib License", "zlib"],
    "boost": ["Boost Software License", "BSL 1.0"],
    "wtfpl": ["WTFPL"],
    "cc-by": ["CC BY 4.0"],
    "cc-by-sa": ["CC BY SA", "CC BY SA 4.0"],
    "cc-by-nc": ["CC BY NC", "CC BY NC 4.0"],
}
#: Short declarations by a name; choices between licences, which declare two families.
FORMS = ["License: {}", "Licensed under {}", "Licensed under the {}", "{} licensed", "terms of the {}"]
CHOICES = {("mit", "apache-2.0"): ["MIT/Apache-2.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT"], ("mit", "gpl"): ["MIT OR GPL", "GPL OR MIT"], ("mpl", "lgpl"): ["MPL OR LGPL", "LGPL OR MPL"]}
#: Other wordings, never learned, on which the level of a known family is calibrated.
APART = {
    "mit": ["This project is distributed under the terms of the MIT license", "The code is MIT licensed, see the MIT License file"],
    "apache-2.0": ["This project uses the Apache License 2.0", "Distributed under the Apache 2.0 license"],
    "gpl": ["Distributed under the GNU GPL v3 or later", "This code is under the GNU General Public License v2"],
    "lgpl": ["This library is under the GNU Lesser General Public License v3", "Available under LGPL 2.1 or later"],
    "agpl": ["The server is under the GNU Affero General Public License v3"],
    "bsd": ["Distributed under the BSD 3-Clause License", "Available under the BSD license"],
    "isc": ["Distributed under the ISC License"],
    "mpl": ["This file is under the Mozilla Public License 2.0"],
    "epl": ["Available under the Eclipse Public License 2.0"],
    "eupl": ["Available under the European Union Public Licence, EUPL 1.2"],
    "public-domain": ["This software is released into the public domain"],
    "zlib": ["Available under the zlib license"],
    "boost": ["Available under the Boost Software License 1.0"],
    "wtfpl": ["This script is under the WTFPL"],
    "cc-by": ["This text is available under CC BY 4.0"],
    "cc-by-sa": ["This text is available under CC BY-SA 4.0"],
    "cc-by-nc": ["This picture is available under CC BY-NC 4.0"],
}
#: Ways to deny a declaration; denied declarations are examples of the unknown class.
DENIED = ["not {}", "is not {}", "this is not {}", "was never {}", "it is no longer {}", "isn't {}", "cannot be {}", "has not been {}"]
#: Ways to name a licence without declaring it, for first names and for all of them.
NAMED = ["we do not use the {}", "do not use the {} here", "we don't use {}", "it does not use the {}", "instead of the {}", "something other than the {}", "unlike the {}", "the {} does not apply", "the {} plate", "{} plates"]
NOTHING = ["nothing here is licensed under {}", "none of it is under the {}", "not licensed under {}"]
#: Sentences with words of licences that declare none.
OTHER = [
    "You need a license to drive", "copyright law is hard to learn", "permission was granted by the council", "the warranty covers parts and labour for two years",
    "apply for a fishing licence before you go", "he studied at MIT in Cambridge", "the Apache tribe and the Apache helicopter", "the general public is invited", "creative people share the commons",
    "public domain of the king", "he lost his pilot license", "a license plate on the car", "all rights reserved", "copyright the author", "the software is sold with a license key", "free software for your phone",
    "the mozilla foundation is in California", "the eclipse of the sun", "an affero wine", "boost your sales", "the European Union is a union", "the bsd conference", "without permission of the owner", "redistribution of wealth",
]
#: Words of a window and between the starts of two; windows of the corpus in the sample, at most; texts around each declaration.
WINDOW, STRIDE, SAMPLE, AROUND = 60, 40, 4000, 10
#: Documents, about, that the sample's windows are taken from.
SAMPLED = 4000
UNKNOWN = "unknown"
#: Share of a template's words and pairs that confirms the likeliest family of a window; further ones need a whole template.
CONFIRMED = 0.75


def declarations() -> dict[str, list[str]]:
    """The templates of each family: its sentences, its names in FORMS, and the choices that name it."""
    chosen = {f: [t for pair, texts in CHOICES.items() if f in pair for t in texts] for f in TEMPLATES}
    return {f: texts + [form.format(name) for name in NAMES[f] for form in FORMS] + chosen[f] for f, texts in TEMPLATES.items()}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pairs(w: Column) -> Column:
    """Each word with the next one."""
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _grams(w: Column) -> Column:
    """Words and their pairs."""
    return F.concat(w, _pairs(w))


def windows(docs: DataFrame) -> DataFrame:
    """``key, n, at, grams`` of each window of each paragraph; paragraphs and windows are numbered.

    ``docs`` has ``key, text``. Every word is in a window; a window has no more than WINDOW words.
    """
    parts = docs.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r]*\n")).alias("n", "part"))
    parts = parts.select("key", "n", words(F.col("part")).alias("w")).where(F.size("w") > 0)
    # The arrays are named more than once below, so that they are made once for a paragraph
    parts = parts.withColumn("pairs", _pairs(F.col("w")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1 - (WINDOW - STRIDE)), F.lit(STRIDE))
    cut = parts.select("key", "n", "w", "pairs", F.explode(starts).alias("at"))
    return cut.select("key", "n", "at", F.concat(F.slice("w", F.col("at") + 1, F.lit(WINDOW)), F.slice("pairs", F.col("at") + 1, F.lit(WINDOW - 1))).alias("grams"))


def _declared(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    """``family, w`` of fixed sentences."""
    rows = ",".join(f"({_quoted(f)}, {_quoted(t)})" for f, texts in sets.items() for t in texts)
    return spark.sql(f"select * from values {rows} as t(family, text)").select("family", words(F.col("text")).alias("w"))


def _quoted(text: str) -> str:
    return '"' + text + '"'


def _unknown() -> dict[str, list[str]]:
    """Sentences that declare no licence, though they have the words of one."""
    said = [t for texts in TEMPLATES.values() for t in texts if t.split()[0] in ("Released", "Licensed")]
    return {UNKNOWN: [d.format(t[0].lower() + t[1:]) for t in said for d in DENIED] + [d.format(names[0]) for names in NAMES.values() for d in NAMED] + [d.format(n) for names in NAMES.values() for n in names for d in NOTHING] + OTHER}


def vocabulary(spark: SparkSession) -> CountVectorizerModel:
    """The features: words and pairs of the fixed sentences, apart from those of APART."""
    told = _declared(spark, declarations()).unionByName(_declared(spark, _unknown()))
    terms = told.select(F.explode(_grams(F.col("w"))).alias("term")).distinct().orderBy("term").collect()  # of fixed sentences
    return CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol="grams", outputCol="features", binary=True)


def background(docs: DataFrame) -> DataFrame:
    """``i, w, mark``: windows of the corpus that the classifier learns as other text, numbered.

    ``docs`` has ``key, text``. Of about SAMPLED of its rows, chosen by hashes of the keys, there are
    the SAMPLE first windows at most, in an order of hashes, without those that hold most of a template.
    """
    share = max(1, docs.count() // SAMPLED)
    plain = docs.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r]*\n")).alias("part"))
    plain = plain.select(words(F.col("part")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1 - (WINDOW - STRIDE)), F.lit(STRIDE))
    plain = plain.select("w", F.explode(starts).alias("at")).select(F.slice("w", F.col("at") + 1, F.lit(WINDOW)).alias("w"), F.xxhash64(F.slice("w", F.col("at") + 1, F.lit(WINDOW))).alias("mark"))
    plain = plain.orderBy("mark", "w").limit(SAMPLE).dropDuplicates(["mark"])
    plain = plain.withColumn("i", F.row_number().over(W.orderBy("mark")) - 1)
    plain = _confirmed(plain.withColumn("grams", _grams(F.col("w"))), None)
    return plain.where(F.col("likeness") < CONFIRMED).select("i", "w", "mark").repartition(8, "i")


def examples(plain: DataFrame) -> DataFrame:
    """``family, grams, apart``: what the classifier learns and, ``apart``, is calibrated on.

    ``plain`` has the windows of ``background``; a quarter of them is kept apart, and a fifth of the
    sentences that declare nothing.
    """
    spark = plain.sparkSession
    told = _declared(spark, declarations()).withColumn("apart", F.lit(False)).unionByName(_declared(spark, APART).withColumn("apart", F.lit(True))).unionByName(_declared(spark, _unknown()).withColumn("apart", F.pmod(F.hash("w"), F.lit(5)) == 0))
    # Each sentence alone, and inside AROUND windows of the corpus
    each = told.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(AROUND))))
    each = each.withColumn("i", F.when(F.col("k") > 0, F.pmod(F.hash("w", "k"), F.lit(SAMPLE)))).withColumn("cut", F.pmod(F.hash("k", "w"), F.lit(WINDOW - 20)) + 1)
    inside = each.join(plain.select("i", F.col("w").alias("about")), "i", "left").where((F.col("k") == 0) | F.col("about").isNotNull())
    about = F.coalesce("about", F.array().cast("array<string>"))
    put = F.slice(F.concat(F.slice(about, F.lit(1), F.col("cut")), F.col("w"), F.slice(about, F.col("cut") + 1, F.lit(WINDOW))), F.lit(1), F.greatest(F.lit(WINDOW), F.col("cut") + F.size("w")))
    made = inside.select("family", put.alias("w"), "apart")
    other = plain.select(F.lit(UNKNOWN).alias("family"), "w", (F.pmod(F.col("mark"), F.lit(4)) == 0).alias("apart"))
    return made.unionByName(other).select("family", _grams(F.col("w")).alias("grams"), "apart")


def _chances(model: LogisticRegressionModel, features: CountVectorizerModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``chances``, each family's probability against the unknown class alone, and ``top``, the likeliest family's place.

    Families do not compete for chances, so a window can have several.
    """
    p = model.transform(features.transform(rows)).withColumn("p", vector_to_array("probability"))
    # Bound as x, p is computed once for a window, also where the planner puts the expression into filters; named
    # inside the inner function it would be computed for each family
    named = lambda f: F.get(F.transform(F.array("p"), f), F.lit(0))
    own = lambda x: F.slice(x, 2, len(TEMPLATES))
    chances = named(lambda x: F.transform(own(x), lambda y: y / (y + F.get(x, F.lit(0)))))
    return p.withColumn("chances", chances).withColumn("top", named(lambda x: F.array_position(own(x), F.array_max(own(x))))).drop("p")


def fit(docs: DataFrame) -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """The features, the classifier and the least chance of a family that is no unknown."""
    names = sorted(TEMPLATES)  # numbers 1..; 0 is the unknown class
    number = F.coalesce(*(F.when(F.col("family") == n, float(i + 1)) for i, n in enumerate(names)), F.lit(0.0))
    plain = background(docs).cache()
    rows = examples(plain).withColumn("label", number).withColumn("weight", F.when(F.col("label") > 0, 2.0).otherwise(1.0)).cache()
    features = vocabulary(docs.sparkSession)
    lr = LogisticRegression(maxIter=30, regParam=0.0003, family="multinomial", weightCol="weight")
    model = lr.fit(features.transform(rows.where(~F.col("apart"))))
    rated = _chances(model, features, rows.where("apart"))
    own = F.when(F.col("label") > 0, F.get("chances", F.col("label").cast("int") - 1))
    best = F.when(F.col("label") == 0, F.array_max("chances"))
    known, unknown = rated.agg(F.percentile(own, 0.1), F.percentile(best, 0.999)).first()
    rows.unpersist()
    plain.unpersist()
    return features, model, min(max(((known or 0.5) + (unknown or 0.0)) / 2, 0.2), 0.7)


def _confirmed(rows: DataFrame, family: str | None) -> DataFrame:
    """``rows`` with ``likeness``: the largest share of a template's words and pairs that ``grams`` holds.

    Of templates of the row's ``family`` column if one is named, else of all.
    """
    forms = _declared(rows.sparkSession, declarations()).select("family", F.array_distinct(_grams(F.col("w"))).alias("form"))
    share = lambda form: F.size(F.array_intersect(F.col("grams"), form)) / F.size(form)
    if family is None:  # a fixed list, as one row
        forms = forms.agg(F.collect_list(F.struct("form")).alias("forms")).withColumn("one", F.lit(1))
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(forms), "one").drop("one")
    else:
        rows = rows.join(F.broadcast(forms.groupBy("family").agg(F.collect_list(F.struct("form")).alias("forms"))), family, "left")
    return rows.withColumn("likeness", F.coalesce(F.array_max(F.transform("forms", lambda t: share(t["form"]))), F.lit(0.0))).drop("forms")


def found(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``key, n, at, family, chance, likeness``: windows of ``docs`` (``key, text``) with each confirmed family.

    The classifier is fitted with a sample of ``corpus`` as other text.
    """
    return found_by(*fit(corpus), docs)


def found_by(features: CountVectorizerModel, model: LogisticRegressionModel, least: float, docs: DataFrame) -> DataFrame:
    """``found`` with a fitted classifier."""
    names = sorted(TEMPLATES)
    rows = _chances(model, features, windows(docs)).where(F.array_max("chances") >= least)
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("family"), F.col("chances").alias("chance"))
    each = F.transform(each, lambda x, i: F.struct(x["family"].alias("family"), x["chance"].alias("chance"), (i + 1 == F.col("top")).alias("is_top")))
    rows = rows.select("key", "n", "at", "grams", F.explode(F.filter(each, lambda x: x["chance"] >= least)).alias("x"))
    rows = _confirmed(rows.select("key", "n", "at", "grams", "x.family", "x.chance", "x.is_top"), "family")
    sure = F.col("likeness") >= F.when(F.col("is_top"), CONFIRMED).otherwise(1.0)
    return rows.where(sure).select("key", "n", "at", "family", "chance", "likeness")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence families that each whole document declares.

    Returns one row per input row: ``doc_id, n_found, families, chance``: how many paragraphs declare
    a known family, the families sorted and joined by commas, and the best chance against the unknown class. Null and empty
    texts have none. Repeated rows each give their row; other columns are not read, whatever their
    names. Without any paragraph in the corpus the sentences alone are learned; an empty table
    gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    hits = found(docs.select("key", "text"), docs).groupBy("key", "n").agg(F.collect_set("family").alias("families"), F.max("chance").alias("chance"))
    per = hits.groupBy("key").agg(F.count("*").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families"), F.max("chance").alias("chance"))
    out = docs.select("doc_id", "key").join(per, "key", "left")
    return out.select("doc_id", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), F.coalesce("families", F.lit("")).alias("families"), "chance")
