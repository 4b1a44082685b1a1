"""Licence scans: a positional index of licence templates, looked up by the rarest words of each template that stand
in a file, with DataFrame functions only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of well-known licences and licence notices, each with its label, the key phrases of which one
#: must stand in the file, and its words.
TEMPLATES = [
    ("agpl", "affero general public license", """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version."""),
    ("agpl", "affero general public license", """You should have received a copy of the GNU Affero General Public License along
        with this program. If not, see"""),
    ("apache", "apache license", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache", "license", """Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License."""),
    ("artistic", "artistic license", """This is free software; you can redistribute it and/or modify it under the terms of the
        Artistic License"""),
    ("boost", "boost software license", """Distributed under the Boost Software License, Version 1.0. (See accompanying file
        LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"""),
    ("boost", "free of charge to any person or organization", """Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license"""),
    ("bsd", "redistribution and use in source and binary forms", """Redistribution and use in source and binary forms, with or
        without modification, are permitted provided that the following conditions are met"""),
    ("bsd", "redistributions", """Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer."""),
    ("bsd", "redistributions in binary form", """Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("bsd", "endorse or promote products", """Neither the name of the copyright holder nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission."""),
    ("cc", "creative commons attribution|licensed under cc", """This work is licensed under a Creative Commons Attribution 4.0
        International License"""),
    ("cc", "creative commons attribution", """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0
        International License. To view a copy of this license, visit http://creativecommons.org/licenses"""),
    ("cc", "licensed under cc", "licensed under CC BY-NC 4.0"),
    ("cc", "licensed under cc", "licensed under CC BY-SA 4.0"),
    ("cc0", "public domain dedication|cc0", """To the extent possible under law, the author has dedicated all copyright and
        related and neighboring rights to this software to the public domain worldwide under the CC0 Public Domain
        Dedication. This software is distributed without any warranty."""),
    ("epl", "eclipse public license", """This program and the accompanying materials are made available under the terms of the
        Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"""),
    ("gpl", "gnu general public license", """This program is free software; you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the
        License, or (at your option) any later version."""),
    ("gpl", "gnu general public license", """You should have received a copy of the GNU General Public License along with this
        program; if not, write to the Free Software Foundation"""),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License version 3"),
    ("isc", "and or distribute this software for any purpose", """Permission to use, copy, modify, and/or distribute this software
        for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies."""),
    ("isc", "the author disclaims all warranties", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("lgpl", "lesser general public license|library general public license", """This library is free software; you can
        redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("lgpl", "lesser general public license", """You should have received a copy of the GNU Lesser General Public License along
        with this library; if not, write to the Free Software Foundation"""),
    ("mit", "permission is hereby granted free of charge to any person obtaining", """Permission is hereby granted, free of
        charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction"""),
    ("mit", "permission is hereby granted|subject to the following conditions", """including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("mit", "all copies or substantial portions", """The above copyright notice and this permission notice shall be included in
        all copies or substantial portions of the Software."""),
    ("mit", "mit license", "Released under the MIT License"),
    ("mpl", "mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If
        a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "free and unencumbered software", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", "express or implied warranty", """This software is provided 'as-is', without any express or implied warranty. In no
        event will the authors be held liable for any damages arising from the use of this software."""),
    ("zlib", "altered source versions", """Altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software."""),
]
#: Words of each passage that are looked up (those with the highest IDF), and the share of those that a file has which
#: must line up.
RAREST, AGREE = 8, 0.5
#: What parts words, as a Java pattern over the text with A-Z lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str) -> list[str]:
    """The words of a fixed passage, which is ASCII."""
    return re.findall("[0-9a-z]+", text.lower())


def words(text: str = "text") -> Column:
    """The whole text's words in order; null and blank texts have none.

    lower() also lowers non-ASCII letters. That moves no word border, and makes no other word equal to one of a base
    phrase: the only sign it turns into a plain letter is the Kelvin sign, and no base phrase has a k.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP), "")


def vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in plain_words(text)})


def probes(frequencies: dict[str, int], rarest: int = RAREST) -> list[list[str]]:
    """Of each passage the words with the highest IDF, ties by the word."""
    return [sorted(set(plain_words(text)), key=lambda w: (frequencies.get(w, 0), w))[:rarest] for _, _, text in TEMPLATES]


def template_index(spark: SparkSession, probed: list[list[str]]) -> DataFrame:
    """Postings (word, template, label, place, the template's looked-up words) of the fixed passages: some 300 rows."""
    postings = [
        {"word": word, "template": number, "label": label, "place": place, "probed": sorted(own)}
        for number, ((label, _, text), own) in enumerate(zip(TEMPLATES, probed, strict=True))
        for place, word in enumerate(plain_words(text))
        if word in own
    ]
    kind = "array<struct<word string, template int, label string, place int, probed array<string>>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(postings)), kind)))


def word_frequencies(docs: DataFrame) -> DataFrame:
    """word and the number of rows of docs that have it, for the licence vocabulary over all rows."""
    known = F.array_intersect(words(), F.array(*map(F.lit, vocabulary())))
    return docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def _stands(phrase: str) -> Column:
    return F.contains(F.col("spaced"), F.lit(f" {phrase} "))


def _starts(phrase: str) -> Column:
    """Word numbers at which the phrase's words stand in column w."""

    def here(i):
        ok = F.lit(True)
        for k, part in enumerate(phrase.split()):
            ok = ok & F.coalesce(F.get(F.col("w"), i + k) == part, F.lit(False))
        return ok

    return F.when(_stands(phrase), F.filter(F.sequence(F.lit(0), F.size("w") - 1), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, rarest: int = RAREST, agree: float = AGREE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs.

    The index holds, of each licence passage, the places of its `rarest` words with the highest IDF over all rows of
    docs (ties: the smaller word). Those of a file's words that it knows are looked up; where file position less passage
    position is the same for at least `agree` of a passage's words that the file has, and for two of them at least, the
    passage is a candidate. A candidate whose key phrase stands in the file adds its label to those of the base phrases.
    score is the largest such share, and one half at least where a base phrase stands.
    Null, empty and blank texts have no words, no labels and score 0. Very long texts are read whole: a row holds its
    words as one array, and only files with two looked-up words of a passage send the places of those words on. Null ids are
    kept; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    seen = {r["word"]: r["df"] for r in word_frequencies(docs).collect()}  # a row a licence word: some 300
    probed = probes(seen, rarest)
    index = template_index(spark, probed)
    wanted = F.array(*map(F.lit, sorted({w for own in probed for w in own})))
    keys = sorted({k for _, phrases, _ in TEMPLATES for k in phrases.split("|")})

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.text_key().alias("text_key"),
        words().alias("w"),
        F.contains(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit("license")).alias("near"),  # every base phrase has it
    )
    rows = rows.withColumn("known", F.array_intersect("w", wanted))
    few = [F.size(F.array_intersect("known", F.array(*map(F.lit, own)))) >= 2 for own in probed]
    rows = rows.withColumn("likely", F.when(F.size("known") >= 2, _any(few)).otherwise(False))
    rows = rows.withColumn("spaced", F.when(F.col("near") | F.col("likely"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).otherwise(""))
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda s: F.array_contains(F.col("known"), s["word"]))
    base = F.concat(*(_starts(p) for p in PHRASES))
    rows = rows.select(
        "doc_id",
        "text_key",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.col("near"), base).otherwise(F.array().cast("array<int>")).alias("base"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(_stands(p), F.lit(label)) for p, label in PHRASES.items()))))).alias("base_labels"),
        F.when(F.col("likely"), F.col("known")).alias("known"),
        F.when(F.col("likely"), places).alias("places"),
        F.when(F.col("likely"), F.array_compact(F.array(*(F.when(_stands(k), F.lit(k)) for k in keys)))).alias("phrases"),
    )
    rows = common.stage(rows, "licences")

    # a text that many rows share is looked up once
    looked = rows.where(F.size("places") >= 2).dropDuplicates(["text_key"]).select("text_key", "known", "phrases", F.inline("places"))
    votes = looked.join(F.broadcast(index), "word")
    votes = votes.withColumn("expected", F.size(F.array_intersect("known", "probed"))).where("expected >= 2")
    votes = votes.groupBy("text_key", "template", "label", "expected", "phrases", (F.col("at") - F.col("place")).alias("offset")).agg(
        F.count_distinct("word").alias("lined_up")
    )
    candidates = votes.where((F.col("lined_up") >= 2) & (F.col("lined_up") >= agree * F.col("expected")))
    mandatory = F.lit(False)
    for number, (_, phrases, _) in enumerate(TEMPLATES):
        mandatory = mandatory | ((F.col("template") == number) & _any([F.array_contains("phrases", k) for k in phrases.split("|")]))
    found = (
        candidates.where(mandatory)
        .groupBy("text_key")
        .agg(F.collect_set("label").alias("found"), F.max(F.col("lined_up") / F.col("expected")).alias("share"))
        .withColumnRenamed("text_key", "_key")
    )
    found = common.stage(found, "licence-labels")  # so that a text with many copies can be split when it is joined
    joined = rows.join(found, F.col("text_key") == F.col("_key"), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    n_base = F.size("base").cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
