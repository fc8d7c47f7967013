"""License scans through a positional index of vocabulary words, with DataFrame functions only.

Templates are short notices, and sentences of the texts, of well-known licences.  Their words, without function words, form a small vocabulary.
1. One pass keeps, of each file, the places of base phrases and of vocabulary words; a file without any keeps nothing.
2. Document frequencies over all files give each vocabulary word its IDF.
3. Each occurrence of a vocabulary word meets the word's postings (template, place in the template).  File place minus
   template place is the relative position; occurrences that agree on both are one placement of that template.
4. A placement is verified: words that weigh at least min_share of the template's IDF stand at their places, and the
   template's key phrase stands consecutively at its place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm._shared import Scratch

# What separates words, the base phrases and their labels, the templates and their key phrases.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("apache-2.0", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "without warranties or conditions"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright"),
    Template("creative-commons", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    # sentences of whole licence texts and of the headers that go into files
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "must reproduce the above copyright notice"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("gpl", "you should have received a copy of the gnu general public license along with this program", "received a copy of the gnu general public license"),
    Template("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "received a copy of the gnu lesser general public license"),
    Template("agpl", "you should have received a copy of the gnu affero general public license along with this program", "received a copy of the gnu affero general public license"),
    Template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "copy of the mpl was not distributed with this file"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose", "anyone is free to copy modify publish use compile sell or distribute"),
)
FUNCTION_WORDS = frozenset((
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "has", "have", "if", "in", "into", "is", "it", "its", "law",
    "may", "must", "no", "nor", "not", "of", "on", "one", "or", "shall", "should", "that", "the", "this", "to", "under", "use", "used", "was", "will",
    "with", "without", "you",
))


@dataclass(frozen=True)
class LicenseRules:
    """min_share: of a template's IDF that must be in place."""

    templates: tuple[Template, ...] = TEMPLATES
    min_share: float = 0.6


def words_column(text: "F.Column") -> "F.Column":
    """The words of a text: A-Z in lower case, split at every ASCII character that is no digit or letter."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def phrase_places(words: str, phrase: str) -> "F.Column":
    """The places at which a phrase's words stand consecutively; looked for only where its rarest word occurs at all."""
    parts = phrase.split()
    anchor = max(range(len(parts)), key=lambda k: (parts[k] not in FUNCTION_WORDS, len(parts[k])))
    size = F.size(words)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(size - len(parts), F.lit(0))),
        lambda i: F.forall(
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)]),
            lambda x: F.get(words, i + x["k"]).eqNullSafe(x["p"]),
        ),
    )
    return F.when(F.array_contains(words, parts[anchor]), starts).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, rules: LicenseRules = LicenseRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score, placements.

    score is 1 where a base phrase stands, else the largest share of a template's IDF found in place, else 0.
    placements lists (label, place of the template's first word, share); the place is below 0 for a notice whose
    beginning the file lacks.  A null text counts as empty; null ids and repeated rows give a row each; other columns
    are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    vocabulary = sorted({w for t in rules.templates for w in t.text.split()} - FUNCTION_WORDS)
    listed = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_column(F.col(text_col)).alias("words"))
    kept = F.when(
        F.arrays_overlap("words", listed),
        F.filter(
            F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word")))),
            lambda x: x.isNotNull(),
        ),
    ).otherwise(F.array().cast("array<struct<pos:int,word:string>>"))
    base = {label: phrase_places("words", phrase) for phrase, label in BASE_PHRASES.items()}
    # key phrases may hold function words, which the vocabulary leaves out: keep where each stands
    keys = sorted({t.key for t in rules.templates})
    any_key = F.arrays_overlap("words", F.array(*[F.lit(max(k.split(), key=lambda w: (w not in FUNCTION_WORDS, len(w)))) for k in keys]))
    key_places = F.when(any_key, F.array(*[phrase_places("words", k) for k in keys])).otherwise(F.array().cast("array<array<int>>"))
    files = scratch.save(
        seen.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.struct(*[x.alias(f"b{i}") for i, x in enumerate(base.values())]).alias("base"),
            kept.alias("found"),
            key_places.alias("keys"),
        )
    )
    occurrences = files.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.pos", "x.word")
    # IDF over all files: one number for each vocabulary word, so the driver holds a bounded table
    total = files.count()
    frequency = {
        r["word"]: r["n"]
        for r in files.select(F.explode(F.array_distinct(F.transform("found", lambda x: x["word"]))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    idf = {w: _idf(total, frequency.get(w, 0)) for w in vocabulary}
    postings, weights = [], {}
    for number, t in enumerate(rules.templates):
        words = t.text.split()
        weights[number] = sum(idf[w] for w in words if w in idf)
        postings += [(number, place, w, idf[w] / weights[number]) for place, w in enumerate(words) if w in idf]
    index = F.broadcast(spark.createDataFrame(postings, "template int, place int, word string, share double"))
    # every occurrence is looked up: the vocabulary is fixed, so a file with many notices costs no more for each word
    placed = (
        occurrences.join(index, "word")
        .withColumn("start", F.col("pos") - F.col("place"))
        .groupBy("row", "template", "start")
        .agg(F.sum("share").alias("share"))
    )
    facts = F.broadcast(
        spark.createDataFrame(
            [(n, t.label, keys.index(t.key), _key_place(t)) for n, t in enumerate(rules.templates)],
            "template int, label string, key int, key_place int",
        )
    )
    verified = (
        placed.where(F.col("share") >= rules.min_share)
        .join(facts, "template")
        .join(files.select("row", "keys"), "row")
        .where(F.array_contains(F.get("keys", F.col("key")), F.col("start") + F.col("key_place")))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("label", "start", F.round("share", 6).alias("share")))).alias("placements"))
    )
    starts = F.array_sort(F.flatten(F.array(*[F.col(f"base.b{i}") for i in range(len(base))])))
    base_set = F.array_compact(
        F.array(*[F.when(F.size(f"base.b{i}") > 0, F.lit(label)) for i, label in enumerate(base)])
    )
    none = F.array().cast("array<struct<label:string,start:int,share:double>>")
    found = files.join(verified, "row", "left").select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.when(F.size(starts) > 0, F.element_at(starts, 1)).cast("long").alias("first_word"),
        F.when(F.size(starts) > 0, F.element_at(starts, -1)).cast("long").alias("last_word"),
        F.array_sort(base_set).alias("base_set"),
        F.coalesce("placements", none).alias("placements"),
    )
    best = F.array_max(F.transform("placements", lambda x: x["share"]))
    labels = F.array_sort(F.array_union("base_set", F.transform("placements", lambda x: x["label"])))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "placements",
    )


def _idf(total: int, with_word: int) -> float:
    from math import log

    return log((total + 1) / (with_word + 1)) + 1


def _key_place(t: Template) -> int:
    words, key = t.text.split(), t.key.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)
