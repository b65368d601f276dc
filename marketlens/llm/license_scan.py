"""License scans: which licences the words of a file state, from a positional index of rare words.

Words are runs of digits, Latin letters and characters beyond ASCII, A-Z in lower case. Two things are looked for in
every whole text:

- the base phrases, wherever their words stand consecutively; each is a place and gives its label;
- templates, the sentences by which files declare a licence. A template has key phrases, which are mandatory.

The index holds, for every word of the key phrases, the templates and the positions where it stands. A word's IDF is
that over the templates; in a file the occurrences of a template's word of the highest IDF (the first of equals) are
looked up, and each proposes where the template would begin. The template's other key words are intersected in order
of falling IDF: one is kept where such a word stands at its relative position, give or take ``SLACK`` words.
What is left is verified: every key phrase must stand, word for word, at most ``SLACK`` words off, and the share
of the template's words found at most ``SLACK`` words off must be ``SHARE`` or more. As key
phrases are mandatory, every place that would be verified is proposed: nothing is cut off or ranked away.

The score is 1 where a base phrase stands, otherwise the largest share of a verified template, otherwise 0.

The work is a projection of each row by itself: no shuffle, no state; texts of one batch are searched together as
an array of word numbers, in slices of bounded size.

Defined results: a null text is empty; an empty one has no words, no places, empty labels and a score of 0;
a text of any length is searched in whole; repeated rows and null ids get a row each; overlapping places of
different templates all count; labels are distinct and sorted; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ship
from marketlens.llm.shingles import text_slices

SLACK, SHARE = 3, 0.75

#: Phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
)

#: Label, sentence and its key phrases (fixed values).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction",
     ("hereby granted free of charge", "associated documentation files")),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ("not use this file except in compliance with the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation",
     ("gnu general public license", "free software foundation")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published"
     " by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published"
     " by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the"
     " following conditions are met", ("source and binary forms", "permitted provided that the following conditions")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted", ("for any purpose with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
     ("accompanying materials", "eclipse public license")),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("unencumbered software", "public domain")),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution", "international license")),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike", "international license")),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this"
     " work", ("related or neighboring rights",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held"
     " liable for any damages arising from the use of this software", ("without any express or implied warranty", "authors be held liable")),
)

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Template:
    label: str
    words: list[int]
    keys: list[tuple[int, list[int]]]  # position and words of each key phrase
    rarest_first: list[tuple[int, int]] = field(default_factory=list)  # (word, position) of the key words


class Index:
    """Templates by the positions of their key words, and the numbers of all words that matter."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.number: dict[bytes, int] = {}
        self.phrases = [(self._numbers(phrase), label) for phrase, label in phrases]
        self.templates: list[Template] = []
        for label, sentence, keys in templates:
            words, own = sentence.split(), []
            for key in keys:
                part = key.split()
                at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
                own.append((at, self._numbers(key)))
            self.templates.append(Template(label, self._numbers(sentence), own))
        holders = Counter(w for t in self.templates for w in set(t.words))
        for t in self.templates:
            idf = {w: math.log(len(self.templates) / holders[w]) for w in t.words}
            spots = {(at + i, w) for at, words in t.keys for i, w in enumerate(words)}
            t.rarest_first = [(w, at) for at, w in sorted(spots, key=lambda s: (-idf[s[1]], s[0]))]
        self.gap = max((len(t.words) for t in self.templates), default=0) + 2 * SLACK + 1

    def _numbers(self, text: str) -> list[int]:
        return [self.number.setdefault(w.encode(), len(self.number)) for w in text.split()]

    def _near(self, places: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Is there a spot at most ``SLACK`` off each place?"""
        return np.searchsorted(spots, places - SLACK) < np.searchsorted(spots, places + SLACK, "right")

    def found(self, words: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
        """(label, places, None) per base phrase; (label, places of its rarest key word, shares) per template.

        ``words`` holds word numbers; texts are set apart by ``gap`` numbers of -1, also at both ends.
        """
        order = np.argsort(words, kind="stable")
        at = np.searchsorted(words[order], np.arange(len(self.number) + 1))
        spots = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

        def stands(phrase: list[int]) -> np.ndarray:
            rarest = min(range(len(phrase)), key=lambda i: len(spots[phrase[i]]))
            places = spots[phrase[rarest]] - rarest
            for i, w in enumerate(phrase):
                places = places[words[places + i] == w]
            return places

        for phrase, label in self.phrases:
            yield label, stands(phrase), None
        for t in self.templates:
            if not all(len(spots[w]) for w, _ in t.rarest_first):
                continue
            word, position = t.rarest_first[0]
            places = spots[word] - position
            for word, position in t.rarest_first[1:]:
                places = places[self._near(places + position, spots[word])]
            for position, phrase in t.keys if len(places) else ():
                places = places[self._near(places + position, stands(phrase))]
            if len(places):
                hit = np.zeros((len(places), len(t.words)), bool)
                expected = places[:, None] + np.arange(len(t.words))
                for off in range(-SLACK, SLACK + 1):
                    hit |= words[np.clip(expected + off, 0, len(words) - 1)] == np.array(t.words)
                share = hit.sum(1) / len(t.words)
                yield t.label, places[share >= SHARE] + t.rarest_first[0][1], share[share >= SHARE]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index()
    number, gap = index.number.get, [-1] * index.gap
    for whole in batches:
        for batch in text_slices(whole, "text"):
            n = batch.num_rows
            parts, first, counts, at = [np.array(gap, np.int16)], np.zeros(n, np.int64), np.zeros(n, np.int64), index.gap
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
                first[row], counts[row] = at, len(words)
                parts += [np.fromiter(map(number, words, repeat(-1)), np.int16, len(words)), parts[0]]
                at += len(words) + index.gap
            places = np.zeros(n, np.int64)
            lowest, highest = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            score, base, labels = np.zeros(n), [set() for _ in range(n)], [set() for _ in range(n)]
            for label, found, share in index.found(np.concatenate(parts)):
                row = np.searchsorted(first, found, "right") - 1
                if share is None:
                    places += np.bincount(row, minlength=n)
                    np.minimum.at(lowest, row, found - first[row])
                    np.maximum.at(highest, row, found - first[row])
                np.maximum.at(score, row, 1.0 if share is None else share)
                for r in np.unique(row).tolist():
                    labels[r].add(label)
                    if share is None:
                        base[r].add(label)
            joined = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            none = places == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts), pa.array(places), pa.array(lowest, mask=none), pa.array(highest, pa.int64(), mask=none),
                 joined(base), joined(labels), pa.array(score)],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document."""
    ship(docs.sparkSession)
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = given.mapInArrow(_scanned, f"id {given.schema['id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, "
                                       "last_word bigint, base_labels string, labels string, score double")
    return found.withColumnRenamed("id", doc_id)
