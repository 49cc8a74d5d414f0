"""Licence scanning by a positional index of rare tokens; DataFrame functions only.

Templates of licence notices are indexed under the rarest words of their mandatory key
phrase: the ``POSTED`` ones with the highest inverse document frequency over the whole corpus,
each with its position. Words of the key phrase are taken because a match has them all in
place: no match is lost, however the rest of a notice was changed or cut. A template whose key
phrase has a word that no document holds can match nowhere and posts nothing. A file looks up
every posted word that it holds, every occurrence proposing a (template, offset); proposals
are intersected by relative position, so at least two posted words must stand where the
template has them, and the key phrase must stand there word by word. The score is the share
of the template's words in place.

Beside the templates' labels, fixed phrases anywhere in a text give the base labels.

Defined cases. A null text counts as empty: no words, no labels, score 0. Ids may be null
or repeated. An empty table gives an empty result. Words are runs of characters other than
ASCII non-alphanumerics, after lower-casing A-Z.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import documents, text_of

POSTED = 4
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """A notice in normalised words; ``key`` is the part of it that must stand in place."""

    label: str
    notice: str
    key: str


# Public licence notices in normalised words
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "version 3 of the license"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    Template("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation either version 2"),
    Template("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license version 1 0", "common development and distribution license"),
    Template("artistic-2", "this package is distributed under the artistic license 2 0", "artistic license 2 0"),
    Template("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    Template("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0", "waived all copyright and related or neighboring rights"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("spdx-mit", "spdx license identifier mit", "spdx license identifier mit"),
    Template("spdx-apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    Template("spdx-bsd-3", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 3 clause"),
    Template("spdx-gpl-2", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    Template("spdx-gpl-3", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


def normalised(text: Column) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " "))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def document_frequencies(texts: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word, over the whole table; as many numbers as there are words."""
    known = sorted({w for t in templates for w in t.notice.split()})
    present = F.array_intersect(F.array(*map(F.lit, known)), words_of(F.col("norm")))
    rows = texts.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in known} | {r["word"]: r["count"] for r in rows}


def posted_words(frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, posted: int = POSTED) -> list[list[tuple[str, int]]]:
    """For each template the rarest words of its key phrase and their first positions there; ties: the earlier word."""
    out = []
    for t in templates:
        key, at = t.key.split(), _key_at(t)
        if not all(frequencies[w] for w in key):
            out.append([])
            continue
        first = {w: at + key.index(w) for w in key}
        out.append(sorted(first.items(), key=lambda x: (frequencies[x[0]], x[1]))[:posted])
    return out


def _phrase_starts(phrase: str) -> Column:
    """Word positions where the phrase stands, of the columns ``norm`` and ``words``."""
    parts = phrase.split()
    here = lambda i: F.expr("true") if not parts else _all([F.get("words", i + k) == w for k, w in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
    return F.when(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).contains(f" {phrase} "), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _aligned(templates: tuple[Template, ...], posted: list[list[tuple[str, int]]], frequencies: dict[str, int]) -> Column:
    """Array of (label, score) of the verified alignments, of the column ``words``."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, entries in enumerate(posted):
        for word, at in entries:
            postings.setdefault(word, []).append((k, at))
    by_idf = sorted(postings, key=lambda w: (frequencies[w], w))
    lookup = F.array(*[
        F.struct(F.lit(w).alias("word"), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(at).alias("at")) for k, at in postings[w]]).alias("places"))
        for w in by_idf
    ])
    info = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"),
            F.array(*map(F.lit, t.notice.split())).alias("notice"),
            F.lit(_key_at(t)).alias("key_at"),
            F.array(*map(F.lit, t.key.split())).alias("key"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(at).alias("at")) for w, at in p]).alias("posted"),
        )
        for t, p in zip(templates, posted)
    ])
    words = F.col("words")
    own = F.filter(lookup, lambda e: F.array_contains(words, e["word"]))
    places = lambda e: F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == e["word"])
    proposed = F.flatten(F.transform(own, lambda e: F.flatten(F.transform(places(e), lambda i: F.transform(e["places"], lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("off")))))))
    stands = lambda t, off: F.size(F.filter(F.get(info, t)["posted"], lambda p: F.get(words, off + p["at"]) == p["word"]))
    # distinct only after the filter: it compares structs in pairs
    meeting = F.array_distinct(F.filter(proposed, lambda c: stands(c["t"], c["off"]) >= 2))
    same = lambda found, start: F.forall(F.transform(found, lambda w, i: F.coalesce(F.get(words, start + i) == w, F.lit(False))), lambda ok: ok)
    verified = F.filter(meeting, lambda c: same(F.get(info, c["t"])["key"], c["off"] + F.get(info, c["t"])["key_at"]))

    def scored(c: Column) -> Column:
        notice = F.get(info, c["t"])["notice"]
        placed = F.size(F.filter(F.transform(notice, lambda w, i: F.coalesce(F.get(words, c["off"] + i) == w, F.lit(False))), lambda ok: ok))
        return F.struct(F.get(info, c["t"])["label"].alias("label"), (placed / F.size(notice)).alias("score"))

    return F.transform(verified, scored)


def _key_at(t: Template) -> int:
    return len(t.notice[: t.notice.index(t.key)].split())


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
    posted: int = POSTED,
) -> DataFrame:
    """(id, n_words, phrases array of (label, starts), matches array of (label, score)) for every row."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("norm"))
    frequencies = document_frequencies(texts, templates)
    live = [(t, entries) for t, entries in zip(templates, posted_words(frequencies, templates, posted)) if entries]
    templates, index = tuple(t for t, _ in live), [entries for _, entries in live]
    licence = F.array(*map(F.lit, sorted({w for entries in index for w, _ in entries}))).cast("array<string>")
    split = texts.withColumn("words", words_of(F.col("norm")))
    size = split.withColumn("candidate", F.arrays_overlap("words", licence))
    starts = F.array(*[F.struct(F.lit(label).alias("label"), _phrase_starts(phrase).alias("starts")) for phrase, label in BASE])
    none = F.array().cast("array<struct<label:string,score:double>>")
    matches = F.when(F.col("candidate"), _aligned(templates, index, frequencies)).otherwise(none) if index else none
    return size.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), starts.alias("phrases"), matches.alias("matches"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir)).withColumn("all", F.flatten(F.transform("phrases", lambda p: p["starts"])))
    base = F.transform(F.filter("phrases", lambda p: F.size(p["starts"]) > 0), lambda p: p["label"])
    own = F.transform("matches", lambda m: m["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, own)).alias("labels"),
        F.greatest(best, F.when(F.size("all") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
