"""License scan by a positional index of rare words.

Every template's key phrases have positions; the index keeps, for each template, the rarest words of these phrases by
their document frequency in the corpus. In a file the indexed words are looked up, each hit proposes the place where its
template would begin, and a place that all rare words of a template propose is verified phrase by phrase.

Rare words come from phrases that must be there in full, so every verifiable place is proposed: the frequencies decide
what the look-up costs, not what it finds. Native functions only; a file is scanned within its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than these, after A-Z are lower-cased; fixed by the contract.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels; fixed by the contract.
BASE: dict[str, str] = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, words of a notice, and the phrases of it that must be there. Wordings of well-known notices.
NOTICES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("use this file except in compliance with the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license", ("licensed under the gnu general public license",)),
    ("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
)

#: Rare words that a template has in the index, and the share of its words that must stand at their places.
RARE, LEAST_SHARE = 3, 0.3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, str], ...]  # where each key phrase begins, and the phrase
    base: bool = False

    def places(self) -> list[tuple[int, str]]:
        """(place, word) of all words of the key phrases."""
        return [(at + i, w) for at, phrase in self.keys for i, w in enumerate(phrase.split())]


def templates(base: Mapping[str, str] = BASE, notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES) -> list[Template]:
    def place(text: str, phrase: str) -> int:
        at = f" {text} ".find(f" {phrase} ")
        if at < 0 or not phrase:
            raise ValueError(f"{phrase!r} is no phrase of {text!r}")
        return text[:at].count(" ")

    out = [Template(label, tuple(phrase.split()), ((0, phrase),), True) for phrase, label in base.items()]
    return out + [Template(label, tuple(text.split()), tuple((place(text, k), k) for k in keys)) for label, text, keys in notices]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and _w, the words of each text."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array_remove(F.split(text, BETWEEN), "").alias("_w"))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def frequencies(docs: DataFrame, known: Sequence[Template], **cols) -> dict[str, int]:
    """In how many documents, of all, each word of a key phrase stands. At most one row for each of these words reaches
    the driver; a document is counted once for a word before the shuffle."""
    vocabulary = sorted({w for t in known for _, w in t.places()})
    found = words(docs, **cols).select(F.explode(F.array_intersect("_w", _strings(vocabulary))).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in found.collect()}


def index(known: Sequence[Template], df: Mapping[str, int], rare: int = RARE) -> list[list[tuple[int, str]]]:
    """For each template its rarest places: those of the words of highest inverse document frequency, ties by word."""
    return [sorted(t.places(), key=lambda x: (df.get(x[1], 0), x[1], x[0]))[:rare] for t in known]


def scan(docs: DataFrame, known: Sequence[Template], rare: Sequence[Sequence[tuple[int, str]]], least_share: float = LEAST_SHARE, **cols) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row a document.

    score is the largest share of a template's words that stand at their places, over all verified places, 0 without one.
    A null or empty text has no words and no labels; a row without an id is scanned with a null id; repeated rows are
    scanned each; an empty table gives no rows; further columns are not read.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, places in enumerate(rare):
        for place, word in places:
            postings.setdefault(word, []).append((t, place))

    def struct(t: Column | int, at: Column | int, names: tuple[str, str] = ("t", "at")) -> Column:
        return F.struct((F.lit(t) if isinstance(t, int) else t).alias(names[0]), (F.lit(at) if isinstance(at, int) else at).alias(names[1]))

    table = F.create_map(*(x for word, found in postings.items() for x in (F.lit(word), F.array(*(struct(t, place) for t, place in found)))))
    needed = F.array(*(F.lit(len(places)) for places in rare))
    keys = F.array(*(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(len(phrase.split())).alias("n"), F.lit(phrase).alias("phrase")) for at, phrase in t.keys)) for t in known))
    every = F.array(*(_strings(t.words) for t in known))
    names, n_base = _strings([t.label for t in known]), sum(t.base for t in known)

    w = words(docs, **cols)
    # look-up: the places of indexed words, -1 elsewhere
    hits = w.select("doc_id", "_w", F.size("_w").cast("long").alias("n_words"), F.filter(F.transform("_w", lambda x, i: F.when(x.isin(list(postings)), i).otherwise(-1)), lambda i: i >= 0).alias("_hits"))
    # each hit proposes where its templates begin; in order of template and place, equal proposals are neighbours
    proposed = F.flatten(F.transform("_hits", lambda i: F.transform(F.element_at(table, F.get("_w", i)), lambda p: struct(p["t"], i - p["at"]))))
    proposals = hits.select("doc_id", "_w", "n_words", F.sort_array(proposed).alias("_p"))
    # intersection: a place that as many words propose as the template has in the index, taken at the first of them
    met = F.filter("_p", lambda p, j: (p["at"] >= 0) & (F.get("_p", j + F.get(needed, p["t"]) - 1) == p) & ~F.coalesce(F.get("_p", j - 1) == p, F.lit(False)))
    candidates = proposals.select("doc_id", "_w", "n_words", met.alias("_c"))
    # verification: every key phrase at its place, and enough of the other words
    whole = F.filter("_c", lambda c: F.forall(F.get(keys, c["t"]), lambda k: F.array_join(F.slice("_w", c["at"] + k["at"] + 1, k["n"]), " ") == k["phrase"]))
    share = lambda c: F.size(F.filter(F.transform(F.get(every, c["t"]), lambda x, i: F.coalesce(F.get("_w", c["at"] + i) == x, F.lit(False))), lambda same: same)) / F.size(F.get(every, c["t"]))
    scored = candidates.select("doc_id", "n_words", F.transform(whole, lambda c: F.struct(c["t"].alias("t"), c["at"].alias("at"), share(c).alias("share"))).alias("_v"))
    kept = scored.select("doc_id", "n_words", F.filter("_v", lambda v: v["share"] >= least_share).alias("_v"), F.filter("_v", lambda v: v["t"] < n_base).alias("_b"))

    def labels(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda v: F.get(names, v["t"])))), ",")

    return kept.select(
        "doc_id",
        "n_words",
        F.size("_b").cast("long").alias("n_base"),
        F.array_min(F.transform("_b", lambda v: v["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_b", lambda v: v["at"])).cast("long").alias("last_word"),
        labels("_b").alias("base_labels"),
        labels("_v").alias("labels"),
        F.coalesce(F.array_max(F.transform("_v", lambda v: v["share"])), F.lit(0.0)).alias("score"),
    )


def licenses(docs: DataFrame, known: Sequence[Template] | None = None, **cols) -> DataFrame:
    """scan with an index made from the frequencies of these documents."""
    known = templates() if known is None else known
    return scan(docs, known, index(known, frequencies(docs, known, **cols)), **cols)
