"""Licence scan by a positional index of rare licence words, in DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word pattern of the scan, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted as they stand.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Licence notices: label, notice, phrases of it that must stand at their places. Fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit-notice", "released under the mit license", ["the mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
]


def _indexed(document_frequency: dict[str, int], templates, per_template: int) -> list[list[tuple[str, int]]]:
    """The rarest words of each template with their positions; ties go to the earlier word."""
    out = []
    for _, text, _ in templates:
        words = text.split()
        rare = sorted(dict.fromkeys(words), key=lambda w: (document_frequency.get(w, 0), words.index(w)))[:per_template]
        out.append([(w, i) for i, w in enumerate(words) if w in rare])
    return out


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _agreeing(index: list[tuple[str, int]], place: Column) -> Column:
    return reduce(Column.__add__, [F.when(F.get("w", place + p) == x, 1).otherwise(0) for x, p in index])


def _starts(words: list[str], phrases: list[str]) -> list[tuple[list[str], int]]:
    """The words of each mandatory phrase and its place in the template."""
    return [(q.split(), next(i for i in range(len(words)) if words[i:][: len(q.split())] == q.split())) for q in phrases]


def _anchors(document_frequency: dict[str, int], words: list[str], phrases: list[str], index: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The words that propose a template's places: each place has all mandatory phrases, so the rarest
    word of these finds every one of them. Without phrases, all index words propose."""
    inside = [(x, at + j) for q, at in _starts(words, phrases) for j, x in enumerate(q)]
    return [min(inside, key=lambda a: (document_frequency.get(a[0], 0), a[1]))] if inside else index


def _best_place(words: list[str], phrases: list[str], index: list[tuple[str, int]], anchors: list[tuple[str, int]], least: int) -> Column:
    """The best share of agreeing index words over the places of a template; null where it is not found."""

    def proposals(spot: Column) -> Column:
        return F.array_compact(F.array(*[F.when(spot["x"] == x, spot["i"] - p) for x, p in anchors]))

    def stands(place: Column) -> Column:
        phrase = reduce(Column.__and__, [(place + at >= 0) & (F.get("w", place + at + j) == x) for q, at in _starts(words, phrases) for j, x in enumerate(q)], F.lit(True))
        return F.coalesce(phrase, F.lit(False)) & (_agreeing(index, place) >= min(max(least, 1), len(index)))

    places = F.filter(F.array_distinct(F.flatten(F.transform("spots", proposals))), stands)
    best = F.array_max(F.transform(places, lambda d: _agreeing(index, d) / len(index)))
    return F.when(F.arrays_overlap("rare", _texts(sorted({x for x, _ in anchors}))), best)


def _phrase_starts(phrase: list[str]) -> Column:
    """Word positions at which the phrase begins."""
    last = len(phrase) - 1

    def ends(i: Column) -> Column:
        return F.coalesce(reduce(Column.__and__, [F.get("w", i - last + j) == x for j, x in enumerate(phrase)]), F.lit(False))

    at = F.filter(F.sequence(F.lit(last), F.greatest(F.size("w") - 1, F.lit(last))), ends)
    return F.when(F.array_contains("w", phrase[-1]), F.transform(at, lambda i: i - last)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, per_template: int = 4, least_agreeing: int = 2) -> DataFrame:
    """Licences of every whole text: base phrases and notices found through rare words.

    A first pass counts in how many texts each template word stands (a table no longer than the
    templates). The index keeps each template's per_template rarest words and their positions. A
    place stands if least_agreeing index words (all, of shorter templates) agree in relative position
    and all mandatory phrases stand at theirs, so every occurrence of the rarest word of a template's
    phrases proposes a place and none is passed over, however many notices a text holds.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best
    share of agreeing index words of a found template; 1 where only base phrases stand; 0 if none).
    Null and empty texts have no words, null first_word and last_word, and empty labels; repeated
    rows are scanned each; an empty table gives no rows; other columns are ignored.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    known = sorted({w for _, t, _ in templates for w in t.split()})
    if any(re.fullmatch(r"[a-z0-9]+", w) is None for w in known):
        raise ValueError("template words are lower-case ASCII letters and digits")
    df = {r["w"]: r["n"] for r in read.select(F.explode(F.array_intersect("w", _texts(known))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    index = _indexed(df, templates, per_template)
    anchors = [_anchors(df, t.split(), phrases, index[k]) for k, (_, t, phrases) in enumerate(templates)]

    found = []  # of each template: places with their scores
    n = F.size("w")
    rare = F.array_intersect(_texts(sorted({x for a in anchors for x, _ in a})), "w")
    spots = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_contains(F.col("rare"), s["x"]))
    for k, (_, text_, phrases) in enumerate(templates):
        found.append(_best_place(text_.split(), phrases, index[k], anchors[k], least_agreeing).alias(f"t{k}"))

    base = []
    for phrase, label in BASE.items():
        base.append(_phrase_starts(phrase.split()).alias(label))
    looked = read.withColumn("rare", rare).withColumn("spots", F.when(F.size("rare") > 0, spots))
    scanned = looked.select("doc_id", n.cast("long").alias("n_words"), *base, *found)
    places = F.concat(*BASE.values())
    labels = F.array_distinct(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in BASE.values()]))
    more = F.array(*[F.when(F.col(f"t{k}").isNotNull(), F.lit(name)) for k, (name, _, _) in enumerate(templates)])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    best = F.array_max(F.array(*[F.col(f"t{k}") for k in range(len(templates))]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, more)).alias("labels"),
        F.coalesce(best, F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).cast("double").alias("score"),
    )
