"""Licence scan: phrases that name a licence, and a positional rare-token index over licence templates.

The index maps each template word to its postings (template, position). A file looks up its highest-IDF licence words;
postings that agree on the position relative to the file propose a template at an offset, the template's mandatory key
phrases must stand there, and most of its words must follow each other there, with a few words put in or left out. IDF
is counted over all files.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import ALNUM, byte_texts

#: Base phrases and the label of each.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Sentences of public licence notices, the label of each, and the phrases that must stand in a match.
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ("licensed under the apache license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("you can redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one", ("mozilla public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software", "public domain")),
)
RARE_WORDS = 12
MIN_ALIGNED = 0.6
#: words that may be put in or left out: two, and one more for each eight words of the template
SLACK, SLACK_WORDS = 2, 8
#: words of a file whose postings are intersected at once
_SLICE_WORDS = 1 << 15


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z (lower-cased), a-z, 0-9 and characters beyond ASCII."""
    return text.translate(ALNUM).split()


class Match(NamedTuple):
    label: str
    start: int
    score: float


def phrase_places(words: list[bytes], phrase: bytes) -> list[int]:
    """Every word index at which the phrase's words stand consecutively, overlaps included."""
    line = b" " + b" ".join(words) + b" "
    want, out, at, spaces, seen = b" " + phrase + b" ", [], 0, 0, 0
    while (at := line.find(want, at)) >= 0:
        spaces += line.count(b" ", seen, at)
        out.append(spaces)
        seen, at = at, at + 1
    return out


def aligned_words(template: list[bytes], part: list[bytes]) -> int:
    """The most words of the template that stand in part in the same order."""
    best = np.zeros(len(part) + 1, np.int64)
    coded = {w: i for i, w in enumerate(dict.fromkeys(template))}
    numbers = np.array([coded.get(w, -1) for w in part], np.int64)
    for w in template:
        longer = np.concatenate([[0], best[:-1] + (numbers == coded[w])])
        best = np.maximum.accumulate(np.maximum(best, longer))
    return int(best[-1])


class TemplateIndex:
    """Postings of template words, and the IDF by which a file's licence words are ranked."""

    def __init__(self, df: dict[bytes, int], files: int, templates=TEMPLATES, rare: int = RARE_WORDS, aligned: float = MIN_ALIGNED, slack: int = SLACK):
        self.words = [words_of(text.encode()) for _, text, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.phrases = [[b" ".join(words_of(p.encode())) for p in phrases] for _, _, phrases in templates]
        #: a file that lacks one of these words lacks a mandatory phrase of the template
        self.needed = [frozenset(w for p in phrases for w in p.split()) for phrases in self.phrases]
        self.rare, self.aligned = rare, aligned
        self.slack = [slack + len(words) // SLACK_WORDS for words in self.words]
        self.postings: dict[bytes, dict[int, np.ndarray]] = defaultdict(dict)
        for t, words in enumerate(self.words):
            for w in set(words):
                self.postings[w][t] = np.array([p for p, x in enumerate(words) if x == w], np.int64)
        self.idf = {w: math.log((files + 1) / (df.get(w, 0) + 1)) for w in self.postings}

    def offsets(self, words: list[bytes], t: int, chosen: set[bytes]) -> Iterator[int]:
        """Offsets of template t, in order, at which two of the chosen words agree; a bounded number of words at a time."""
        least, reach = min(2, len(set(self.words[t]))), len(self.words[t])
        for lo in range(-reach, len(words), _SLICE_WORDS):
            found = []
            at: dict[bytes, list[int]] = defaultdict(list)
            for i in range(max(0, lo), min(len(words), lo + _SLICE_WORDS + reach)):
                if words[i] in chosen:
                    at[words[i]].append(i)
            for w, places in at.items():
                found.append(np.unique(np.array(places, np.int64)[:, None] - self.postings[w][t]))
            if found:
                agreed, times = np.unique(np.concatenate(found), return_counts=True)
                yield from agreed[(times >= least) & (agreed >= lo) & (agreed < lo + _SLICE_WORDS)].tolist()

    def matches(self, words: list[bytes]) -> list[Match]:
        """The best place of each label. A file's own words decide which templates are looked at, none is left out by rank."""
        present = self.postings.keys() & set(words)
        best: dict[str, Match] = {}
        for t, template in enumerate(self.words):
            label = self.labels[t]
            if not self.needed[t] <= present or label in best and best[label].score == 1.0:
                continue
            # of each template the file's rarest words, so that one licence in a file does not hide another
            chosen = set(heapq.nsmallest(self.rare, present.intersection(template), key=lambda w: (-self.idf[w], w)))
            slack, last = self.slack[t], None
            for at in self.offsets(words, t, chosen):
                part = words[max(0, at - slack) : at + len(template) + slack]
                line = b" " + b" ".join(part) + b" "
                if line == last or not all(b" " + p + b" " in line for p in self.phrases[t]):
                    continue
                score, last = aligned_words(template, part) / len(template), line
                if score >= self.aligned and (label not in best or score > best[label].score):
                    best[label] = Match(label, max(0, at), score)
                    if score == 1.0:
                        break
        return [best[label] for label in sorted(best)]


def licence_statistics(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Files that hold each template word, and all files: counted over every row, in each task first.

    At most one row for each template word reaches the driver.
    """
    vocabulary = frozenset(w for _, text, _ in templates for w in words_of(text.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        files = 0
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                df.update(vocabulary.intersection(words_of(text)))
                files += 1
        names = [*df, b""]
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in names]), pa.array([*df.values(), files], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found, found.pop(b"", 0)


_MATCH = "array<struct<label:string,start:long,score:double>>"
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (places of base phrases), matches (of the template index).

    Null and empty texts have no words and no matches; repeated rows and null ids stay; other columns are not read.
    Very long texts are searched whole, a slice at a time, in memory that follows their length.
    """
    index_of = licence_statistics(docs, text_col, templates)
    shared = docs.sparkSession.sparkContext.broadcast(index_of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(*shared.value, templates)
        for batch in batches:
            count, base, found = [], [], []
            for text in byte_texts(batch.column(1)):
                words = words_of(text)
                count.append(len(words))
                places = [(at, label) for phrase, label in BASE_PHRASES for at in phrase_places(words, phrase.encode())] if b"license" in words else []
                base.append([{"label": label, "start": at, "score": 1.0} for at, label in sorted(places)])
                found.append([m._asdict() for m in index.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(base, _ARROW), pa.array(found, _ARROW)], names=["doc_id", "n_words", "base", "matches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, base {_MATCH}, matches {_MATCH}")


def licence_digest(found: DataFrame) -> DataFrame:
    """The query's columns. score: 1 for a base phrase, else the best template's share of aligned words, else 0."""
    labels = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"])
    others = F.transform("matches", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, others)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
