"""Licence scan: a trained paragraph classifier whose predictions are confirmed against templates.

Only built-in functions and JVM-side ML are used. Every paragraph of every text becomes a sparse vector of word and
word-pair hashes; multinomial logistic regression names a licence family, "unknown" (a licence statement that names no
family known here) or none. No word list decides what is scored. Paragraphs are lines, with lines that were wrapped
joined again, and long ones by sentence. The classifier is trained here, on the templates below with words dropped and
strange words around, on sentences that use licence terms for something else, and on made-up words. Scores are
calibrated by one temperature, chosen by log-loss on texts of their own that training never sees. A prediction counts
as confirmed if enough of a template of its family, in word pairs, stands in the paragraph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import keyed

FEATURES = 1 << 14
LONG_LINE = 600
#: A line of this many characters that ends in a letter, digit, comma, quote or bracket goes on in the next one.
WRAPPED = 40
#: Notices by which the families are known.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "Released under the GNU GPL version 2 or later."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "Released under the ISC License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright the authors. All rights reserved."),
    ("proprietary", "This software is proprietary and confidential; unauthorised copying is strictly prohibited."),
    ("apache-2.0", "Lizenziert unter der Apache-Lizenz, Version 2.0."),
    ("apache-2.0", "Distribué sous la licence Apache, version 2.0."),
    ("mit", "Veröffentlicht unter der MIT-Lizenz."),
    ("mit", "Ce logiciel est distribué sous licence MIT."),
    ("mit", "Publicado bajo la licencia MIT."),
    ("mit", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("gpl", "Dieses Programm steht unter der GNU General Public License, Version 3."),
    ("gpl", "Ce programme est un logiciel libre distribué sous la licence publique générale GNU."),
    ("gpl", "Este programa es software libre bajo la licencia pública general GNU."),
    ("gpl", "GPLv3 or later"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz."),
    ("cc-by", "Available under CC BY 4.0."),
    ("cc-by-sa", "Cette œuvre est mise à disposition selon la licence Creative Commons Attribution - Partage dans les mêmes conditions."),
    ("cc-by-sa", "Available under CC BY-SA 4.0."),
    ("cc-by-nc", "Available under CC BY-NC 4.0."),
    ("public-domain", "Released into the public domain under CC0."),
    ("proprietary", "Alle Rechte vorbehalten."),
    ("proprietary", "Tous droits réservés."),
    ("proprietary", "Todos los derechos reservados."),
]
#: Licence statements that name no family known here.
UNNAMED = [
    "Licensed under the terms found in the LICENSE file.", "This software is licensed under the Northwind Public License, version 2.", "See the license for the terms that govern use of this file.", "Released under a permissive open source license.",
    "Use of this file is subject to the license agreement that came with it.", "Distributed under the Artistic License 2.0.", "Licensed under the Eclipse Public License 1.0.", "Dieses Werk steht unter einer freien Lizenz.", "Publié sous une licence libre.", "Publicado bajo una licencia libre.",
]
#: Texts for the calibration alone, with the family they belong to ("none", "unknown").
CALIBRATION = [
    ("apache-2.0", "The code is available under the terms of the Apache License, Version 2.0, January 2004."), ("apache-2.0", "Our library is licensed under Apache License 2.0."),
    ("mit", "All sources here are released under the MIT License, see the file LICENSE."), ("mit", "The tool is MIT licensed: permission is hereby granted, free of charge, to any person obtaining a copy."),
    ("gpl", "You may copy this program under the GNU General Public License, version 2."), ("gpl", "The plug-in is free software, licensed under the GNU GPL version 3 or later."),
    ("lgpl", "The widgets are covered by the GNU Lesser General Public License."), ("agpl", "The server is licensed under the GNU Affero General Public License."), ("bsd", "It is distributed under the BSD 3-Clause License."), ("bsd", "The parser is governed by a BSD-style license."),
    ("mpl-2.0", "These files are subject to the Mozilla Public License, v. 2.0."), ("isc", "Distributed under the ISC License."), ("cc-by", "The photographs are licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("cc-by-nc", "The recordings are licensed under CC BY-NC 4.0."), ("public-domain", "The author released the work into the public domain."), ("proprietary", "Copyright 2019 by the publisher. All rights reserved."), ("unknown", "Licensed under the Example Community License."), ("unknown", "The license terms are in a file of their own."),
    ("none", "Hunters need a license in this county."), ("none", "The museum asked for permission to copy the painting."), ("none", "He spoke about copyright for an hour."), ("none", "The rights of the tenants are well protected."), ("none", "A free trip for any person who finds the treasure."), ("none", "The general opened the public library."),
    ("none", "Version 3 of the plan was rejected."), ("none", "Software is sold in the shop near the river."), ("none", "Das Fahrzeug steht unter der Brücke."), ("none", "La ville est connue pour ses musées."), ("none", "El río pasa bajo el puente viejo."),
]
#: Sentences with licence terms that grant nothing.
OTHERS = [
    "Her driving license was suspended for two months.", "The restaurant lost its liquor license last year.", "He is a licensed electrician from the north.", "You need a fishing license to stay at the lake.",
    "The city will license more taxi drivers in the spring.", "Copyright law is taught in the third term.", "The court ruled that copyright in the song had lapsed.", "A lecture on copyright and its history follows.",
    "Permission to land was refused by the tower.", "She asked for permission to leave early.", "The warranty on the boiler ends in May.", "Land was redistributed among the farmers.",
    "Workers marched for their rights and were heard.", "The rights to the film were sold abroad.", "Public domain land borders the park.", "A license plate was found near the river.",
    "The nurse showed her professional license at the door.", "They discussed software licensing costs at the meeting.", "His license to practise medicine came from Vienna.", "Creative people often share a common office.",
    "The commission will license two radio stations.", "An article about which license to choose for data.", "The general public may use the library at the weekend.", "Free software is a topic of the course.",
]
NONE, UNKNOWN = "none", "unknown"
FILLER = "the of and a in on that it was for with as at by from this over under near after before small large old new house river day work".split()
COMMON = " ".join(FILLER) + " is to be or are you may not any all these its which see use if has have an but no they he she his her their we our can will would there then when what who so more one two other such only also than into out up about"
COMMON += " der die das und mit von zu im auf ist nicht ein eine einer den dem des sich auch für als werden le la les et en un une est que dans par pour sur du au des pas el los las y con por es una del al se su más"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+]+|\.(?=[^\p{L}\p{N}]|$)"), lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words, each once."""
    both = lambda t: F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return once(tokens, lambda t: F.array_distinct(F.concat(t, F.filter(both(t), lambda pair: pair.isNotNull()))))


def features(tokens: Column) -> Column:
    """Hashes of words and of pairs of neighbouring words: what the classifier counts, once or more often."""
    before = lambda h: F.greatest(F.size(h) - 1, F.lit(0))
    pairs = lambda h: F.zip_with(F.slice(h, 1, before(h)), F.slice(h, 2, before(h)), lambda a, b: F.xxhash64(a, b))
    return once(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.concat(h, pairs(h)))


def classes() -> list[str]:
    """None, unknown and the families: a label is a place in this list."""
    return [NONE, UNKNOWN, *sorted({f for f, _ in TEMPLATES})]


def examples(spark: SparkSession, rounds: int = 15) -> DataFrame:
    """``(label, hashes)``: templates and other sentences, changed by rules that a hash draws from, and made-up words."""
    named = classes()
    texts = [(named.index(f), t) for f, t in TEMPLATES] + [(named.index(UNKNOWN), t) for t in UNNAMED] + [(named.index(NONE), t) for t in OTHERS]
    base = spark.createDataFrame([(float(label), t) for label, t in texts], "label double, text string")
    rows = base.select("label", "text", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("t", words(F.col("text")))
    draw = lambda *c: F.pmod(F.xxhash64("text", "round", *c), F.lit(100))
    share = F.when(F.col("round") == 0, 100).otherwise(90)
    kept = F.filter("t", lambda w, i: draw(i) < share)
    strange = lambda k: F.transform(F.sequence(F.lit(1), 1 + F.pmod(F.xxhash64("text", "round", F.lit(k)), F.lit(6)).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, FILLER)), 1 + F.pmod(F.xxhash64("text", "round", F.lit(k), i), F.lit(len(FILLER))).cast("int")))
    around = F.when(F.col("round") % 3 == 0, kept).when(F.col("round") % 3 == 1, F.concat(strange(-1), kept)).otherwise(F.concat(kept, strange(-2)))
    varied = rows.select("label", features(around).alias("hashes")).where(F.size("hashes") > 0)
    # Common words among words that occur nowhere else stand for all other paragraphs, one to 120 words long.
    size = 1 + F.pmod(F.xxhash64("id"), F.lit(120)).cast("int")
    common = F.element_at(F.split(F.lit(COMMON), " "), 1 + F.pmod(F.xxhash64("id", F.col("x")), F.lit(len(COMMON.split()))).cast("int"))
    word = F.when(F.pmod(F.xxhash64("x", "id"), F.lit(3)) > 0, common).otherwise(F.hex(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 40))))
    made_up = spark.range(len(texts) * rounds // 2).select("id", F.explode(F.sequence(F.lit(1), size)).alias("x")).select("id", "x", word.alias("w")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("x", "w")))["w"].alias("t"))
    return varied.union(made_up.select(F.lit(0.0), features(F.col("t"))))


def _vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="hashes", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows)


def _calibrated(raw: Column, temperature: float) -> Column:
    shifted = lambda r: once(F.array_max(r), lambda most: F.transform(r, lambda x: F.exp((x - most) / temperature)))
    shares = lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return once(raw, lambda r: once(shifted(r), shares))


def train(spark: SparkSession) -> tuple[LogisticRegressionModel, float]:
    """The classifier and its temperature. Training rows are built from the fixed texts above, about two thousand."""
    rows = _vectors(examples(spark)).coalesce(1).cache()
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=40, standardization=False).fit(rows)
    rows.unpersist()
    apart = spark.createDataFrame([(classes().index(f), t) for f, t in CALIBRATION], "label int, text string").coalesce(1)
    held = model.transform(_vectors(apart.withColumn("hashes", features(words(F.col("text")))))).select("label", vector_to_array("rawPrediction").alias("raw"))
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
    loss = lambda t: F.avg(-F.log(F.greatest(F.element_at(_calibrated(F.col("raw"), t), F.col("label") + 1), F.lit(1e-12))))
    losses = held.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    return model.setProbabilityCol("").setPredictionCol(""), grid[min(range(len(grid)), key=lambda i: losses[i])]


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rid, paragraph, text)``: every paragraph that holds a letter or digit.

    A line break after a line of WRAPPED characters or more that ends in a letter, digit, comma, quote or bracket counts
    as a space, unless an empty line follows. Paragraphs of over LONG_LINE characters are taken by sentence, so no row but a long sentence is long.
    """
    joined = F.regexp_replace("text", rf"\n(?<=[^\n]{{{WRAPPED}}}[\p{{L}}\p{{N}},)\"'][ \t\r]{{0,4}}\n)[ \t]*(?=[^\s])", " ")
    parts = F.flatten(F.transform(F.split(joined, "\n"), lambda line: F.when(F.length(line) > LONG_LINE, F.split(line, r"(?<=[.!?;])\s+")).otherwise(F.array(line))))
    return keyed(docs, id_col, text_col).select("doc_id", "rid", F.posexplode(parts).alias("paragraph", "text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def scan(docs: DataFrame, confidence: float = 0.5, similarity: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, family, probability, similarity, confirmed, text)`` of every paragraph that states a licence.

    A paragraph is listed if its calibrated probability of stating none is under a half. ``family`` is "unknown" where
    the probability of the best family stays under ``confidence``; ``probability`` is that of the best class but none;
    ``similarity`` is the largest share of a template's word pairs found in the paragraph, over the templates of the
    family (null for unknown); ``confirmed`` asks for ``similarity`` of it at least. Null and empty texts have no
    paragraphs, very long ones are taken apart by line and sentence, null ids and repeated rows are kept (each gives its
    rows), an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    model, temperature = train(spark)
    found = paragraphs(docs, id_col, text_col).withColumn("hashes", features(words(F.col("text"))))
    scored = model.transform(_vectors(found)).select("doc_id", "paragraph", "text", vector_to_array("rawPrediction").alias("raw"))
    scored = scored.withColumn("p", _calibrated(F.col("raw"), temperature)).where(F.col("p")[0] < 0.5)
    stated = F.slice("p", 2, len(classes()))
    best = F.array_max(F.slice("p", 3, len(classes())))
    family = F.when(best < confidence, UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, classes()[2:])), F.array_position(F.slice("p", 3, len(classes())), best).cast("int")))
    scored = scored.select("doc_id", "paragraph", "text", grams(words(F.col("text"))).alias("grams"), family.alias("family"), F.array_max(stated).alias("probability"))
    # The templates are a fixed list, so they stand in the expression instead of a join.
    known = [(f, F.split(F.lit(_pairs(t)), "\\|")) for f, t in TEMPLATES]
    share = F.greatest(*[F.when(F.col("family") == f, F.size(F.array_intersect(p, F.col("grams"))) / F.size(p)) for f, p in known])
    out = scored.withColumn("similarity", share)
    return out.select("doc_id", "paragraph", "family", "probability", "similarity", F.coalesce(F.col("similarity") >= similarity, F.lit(False)).alias("confirmed"), "text")


def _pairs(text: str) -> str:
    """The word pairs of a template, as words() and grams() make them, joined by bars."""
    import re

    tokens = [w for w in re.split(r"[^\w.+]+|\.(?=[\W_]|$)", text.lower()) if w]
    return "|".join(dict.fromkeys(f"{a} {b}" for a, b in zip(tokens, tokens[1:])))
