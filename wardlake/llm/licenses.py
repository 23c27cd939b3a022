"""License scans: a positional index of the rarest words of licence notices.

Fixed phrases (the base) are found where their words stand consecutively. Notices in full are found by an index:
of each notice the words with the highest inverse document frequency over all documents are indexed with their
place in the notice. All indexed words that a document holds are looked up, however many, postings that agree on the
relative position (word place minus notice place) are intersected, and a notice is accepted where enough rare words agree
and all its mandatory phrases stand in order. Copies of notices drift: words are put in, lines begin with a comment leader. So
relative positions agree if they lie in one of two overlapping ranges of ``DRIFT`` places, and up to ``GAP`` words may stand between two words of a
phrase. Only DataFrame functions are used; the index is a constant of a few hundred entries.

Defined results: null, empty and wordless texts have no places and empty labels. Repeated rows get the same result each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label, the wording of a licence notice, and the phrases of it that must stand.
NOTICES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ("gnu affero general public license",)),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
     ("licensed under the apache license", "except in compliance with the license")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
     "software and accompanying documentation covered by this license", ("to any person or organization obtaining a copy",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution", "international license")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
     ("creative commons attribution noderivatives",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ("creative commons attribution sharealike",)),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and "
     "related or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
     ("eclipse public license",)),
    ("eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent "
     "versions of the EUPL (the \"Licence\")", ("licensed under the eupl",)),
    ("eupl", "Licensed under the EUPL, Version 1.2", ("licensed under the eupl",)),
    ("eupl", "distributed under the terms of the European Union Public Licence", ("european union public licence",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version", ("gnu general public license", "free software foundation")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("gnu lesser general public license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction",
     ("to any person obtaining a copy of this software", "to deal in the software without restriction")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("mozilla public license",)),
    ("mpl", "distributed under the Mozilla Public License", ("under the mozilla public license",)),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("free and unencumbered software released into the public domain",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
)

#: Indexed words of each notice.
INDEXED = 6
#: Places by which the words of one copy of a notice may be shifted against each other, and words between two of a phrase.
DRIFT, GAP = 24, 3


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def file_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place in the notice, words

    @classmethod
    def of(cls, label: str, text: str, phrases: tuple[str, ...]) -> Notice:
        words, placed = tuple(words_of(text)), []
        for phrase in phrases:
            part = tuple(words_of(phrase))
            at = next((i for i in range(len(words)) if words[i : i + len(part)] == part), None)
            if at is None:
                raise ValueError(f"'{phrase}' does not stand in the notice of {label}")
            placed.append((at, part))
        return cls(label, words, tuple(placed))


def document_frequency(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each of a bounded list of words; counted over all texts."""
    found = docs.select(F.explode_outer(F.array_intersect(file_words(F.col("text")), F.array(*map(F.lit, words)))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return docs.count(), {w: counts.get(w, 0) for w in words}


def base_places(words: Column) -> Column:
    """array<struct<at, label>> of every place of a phrase."""
    return F.concat(*[_phrase_places(words, phrase.split(), label) for phrase, label in PHRASES])


def _phrase_places(words: Column, parts: list[str], label: str) -> Column:
    stands = lambda i: F.coalesce(_all([F.get(words, i + k) == p for k, p in enumerate(parts)]), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
    there = _all([F.array_contains(words, p) for p in parts]) & (F.size(words) >= len(parts))
    places = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    return F.when(there, places).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, notices: tuple = NOTICES, indexed: int = INDEXED) -> DataFrame:
    """Phrases and notices of every document (doc_id, text; other columns are ignored).

    ``found`` holds the notices: label, first word and the share of the notice's words that stand in place.
    """
    docs = docs.select("doc_id", "text")
    known = [Notice.of(*n) for n in notices]
    vocabulary = sorted({w for n in known for w in n.words})
    n_docs, df = document_frequency(docs, vocabulary)
    idf = {w: math.log((n_docs + 1) / (df[w] + 1)) for w in vocabulary}
    rare = [sorted(set(n.words), key=lambda w: (-idf[w], w))[:indexed] for n in known]
    need = [max(2, len(r) // 2) for r in rare]
    ordered = sorted({w for r in rare for w in r}, key=lambda w: (-idf[w], w))
    # the first place of a word in a notice; a later one is off by a few words, which is what ``DRIFT`` is for
    postings = [(w, t, n.words.index(w)) for t, n in enumerate(known) for w in rare[t]]

    index = F.array(*map(F.lit, ordered))
    entries = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("notice"), F.lit(at).alias("at")) for w, t, at in postings])
    needs = F.array(*map(F.lit, need))
    out = docs.select("doc_id", file_words(F.col("text")).alias("words"))
    out = out.select("*", F.array_intersect(index, F.col("words")).alias("lookup"))
    # places only in documents with enough licence words; there, one row of work for each hit
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("lookup", x["word"]))
    out = out.select("*", F.when(F.size("lookup") >= min(need), hits).alias("hits"))
    def placed(h: Column, e: Column, shift: int) -> Column:
        start = h["at"] - e["at"]
        return F.struct(e["notice"].alias("notice"), F.floor((start + shift) / DRIFT).alias("range"), F.lit(shift).alias("shift"), h["word"].alias("word"), start.alias("start"))

    of = lambda h: F.filter(entries, lambda e: e["word"] == h["word"])
    both = lambda h: F.concat(F.transform(of(h), lambda e: placed(h, e, 0)), F.transform(of(h), lambda e: placed(h, e, DRIFT // 2)))
    lines = F.array_sort(F.flatten(F.transform("hits", both)))
    # of each word in a range the first place; sorted by notice, shift and range, enough words agree if the entry need - 1 further on has the same three
    out = out.select("*", _ordered(lines).alias("sorted"))
    first = lambda x, i: ~F.coalesce(_same(x, F.get("sorted", i - 1)) & (F.get("sorted", i - 1)["word"] == x["word"]), F.lit(False))
    out = out.select("*", F.filter("sorted", first).alias("lines"))
    ahead = lambda x, i: F.get("lines", i + F.get(needs, x["notice"]) - 1)
    agree = F.filter("lines", lambda x, i: F.coalesce(_same(x, ahead(x, i)), F.lit(False)))
    place = lambda x: F.struct(x["notice"].alias("notice"), x["shift"].alias("shift"), x["range"].alias("range"))
    out = out.select("*", F.array_distinct(F.transform(agree, place)).alias("aligned"))
    begin = lambda a: F.array_min(F.transform(F.filter("lines", lambda x: _same(a, x)), lambda x: x["start"]))
    starts = F.transform("aligned", lambda a: F.struct(a["notice"].alias("notice"), begin(a).alias("start")))
    out = out.select("*", F.sort_array(F.array_distinct(starts)).alias("starts"))
    accepted = F.filter("starts", lambda a: _verified(known, a))
    out = out.select("*", accepted.alias("accepted"))
    # one copy can agree in ranges of both kinds
    again = lambda a, b: F.coalesce((a["notice"] == b["notice"]) & (a["start"] - b["start"] < DRIFT), F.lit(False))
    labels = F.array(*[F.lit(n.label) for n in known])
    found = F.transform(
        F.filter("accepted", lambda a, i: ~again(a, F.get("accepted", i - 1))),
        lambda a: F.struct(F.get(labels, a["notice"]).alias("label"), F.greatest(a["start"], F.lit(0)).alias("at"), _share(known, a).alias("share")),
    )
    out = out.select("*", base_places(F.col("words")).alias("base"), F.coalesce(found, F.array().cast("array<struct<label:string,at:int,share:double>>")).alias("found"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    all_labels = F.array_sort(F.array_union(F.transform("base", lambda b: b["label"]), F.transform("found", lambda f: f["label"])))
    return out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        all_labels.alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))).alias("score"),
        "found",
    )


def _same(a: Column, b: Column) -> Column:
    return (a["notice"] == b["notice"]) & (a["shift"] == b["shift"]) & (a["range"] == b["range"])


def _ordered(lines: Column) -> Column:
    order = ("notice", "shift", "range", "word", "start")
    return F.sort_array(F.transform(lines, lambda x: F.struct(*[x[c].alias(c) for c in order])))


def _region(known: list[Notice], a: Column) -> Column:
    """The words among which a copy of the notice lies; ``a`` is a struct of notice and start."""
    sizes = F.array(*[F.lit(len(n.words)) for n in known])
    low = F.greatest(a["start"] - DRIFT, F.lit(0))
    high = F.least(a["start"] + F.get(sizes, a["notice"]) + 2 * DRIFT, F.size("words"))
    return F.slice("words", low + 1, F.greatest(high - low, F.lit(0)))


def _stands(region: Column, phrase: Column) -> Column:
    """The words of the phrase stand in this order, each at most ``GAP`` words behind the one before."""

    def step(at: Column, word: Column) -> Column:
        return F.coalesce(*[F.when(F.get(region, at + k) == word, at + k) for k in range(1, GAP + 2)])

    begins = F.filter(F.sequence(F.lit(0), F.size(region)), lambda i: F.coalesce(F.get(region, i) == F.get(phrase, F.lit(0)), F.lit(False)))
    rest = F.slice(phrase, F.lit(2), F.size(phrase))
    return F.exists(begins, lambda i: F.aggregate(rest, i, step).isNotNull())


def _verified(known: list[Notice], a: Column) -> Column:
    """All mandatory phrases of the notice stand; ``a`` is a struct of notice and start."""
    phrases = F.array(*[F.struct(F.lit(t).alias("notice"), F.array(*map(F.lit, part)).alias("words")) for t, n in enumerate(known) for _, part in n.phrases])
    own = F.filter(phrases, lambda p: p["notice"] == a["notice"])
    return F.forall(own, lambda p: _stands(_region(known, a), p["words"]))


def _share(known: list[Notice], a: Column) -> Column:
    """Share of the notice's different words that stand in the region."""
    words = F.array(*[F.array(*map(F.lit, dict.fromkeys(n.words))) for n in known])
    own = F.get(words, a["notice"])
    return F.size(F.array_intersect(own, _region(known, a))) / F.size(own)
