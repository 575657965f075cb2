"""Operator 9: licence scans with a generalised suffix automaton over licence words.

All template texts and phrases go into one automaton, word by word.  A document is streamed
through it, which gives for every word the longest run ending there that occurs in any
template (matching statistics).  A word pair that no template holds ends every run, so only the
stretches of known pairs are streamed.  Runs that can't be extended become matches; the matches
of all stretches of a row are chained template by template in growing order, across changed or inserted
words, and a chain that covers enough of the template, and of its own part of the document, is a span
with the template's label.

Contract of `scanned`: null text counts as empty (no words, no labels, score 0); repeated rows
and null ids give one row each; an empty table gives an empty result; very long texts are
streamed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .textcore import ALNUM_LOWER, Words, chunks, text_buffers

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose places are counted.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Openings and notices of public licences: label, text (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
]
#: Words of a match that may start or continue a chain; shorter templates need one whole match.
LEAST_MATCH = 3
SHORT_TEMPLATE = 20
COVER = 0.7


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Span(NamedTuple):
    label: str
    first: int
    last: int
    cover: float


class LicenseAutomaton:
    """Generalised suffix automaton; every state knows one end position in each template it occurs in."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        self.labels = [x for x, _ in templates]
        self.texts = [words_of(t) for _, t in templates]
        self.phrases = [(x, words_of(p)) for x, p in phrases]
        both = self.texts + [p for _, p in self.phrases]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in both for w in t}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for k, text in enumerate(both):
            last = 0
            for pos, word in enumerate(text):
                last = self._extend(last, self.ids[word])
                if k < len(self.texts):
                    self.ends[last].setdefault(k, []).append(pos)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            above = self.ends[self.link[state]]
            for k, found in self.ends[state].items():
                above[k] = sorted({*above.get(k, []), *found})
        self.phrase_at: dict[int, list[tuple[str, int]]] = {}
        for label, phrase in self.phrases:
            state = 0
            for word in phrase:
                state = self.next[state][self.ids[word]]
            self.phrase_at.setdefault(state, []).append((label, len(phrase)))
        self.pairs = {(self.ids[a], self.ids[b]) for t in both for a, b in zip(t, t[1:], strict=False)}

    def _copy(self, state: int, size: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.size.append(size)
        self.ends.append({})
        return len(self.size) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            held = self.next[last][word]
            if self.size[held] == self.size[last] + 1:
                return held
            return self._split(last, word, held)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        self.ends.append({})
        new, p = len(self.size) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            held = self.next[p][word]
            self.link[new] = held if self.size[held] == self.size[p] + 1 else self._split(p, word, held)
        return new

    def _split(self, p: int, word: int, held: int) -> int:
        clone = self._copy(held, self.size[p] + 1)
        self.link[held] = clone
        while p >= 0 and self.next[p].get(word) == held:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest template run that ends here) for each word; -1: unknown word."""
        state = length = 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state = length = 0
            yield state, length

    def phrase_places(self, trace: list[tuple[int, int]]) -> list[tuple[str, int]]:
        """(label, first word) of every place of a phrase."""
        found = []
        for at, (state, length) in enumerate(trace):
            while state > 0:
                for label, n in self.phrase_at.get(state, ()):
                    if n <= length:
                        found.append((label, at - n + 1))
                state = self.link[state]
        return found

    def matches(self, trace: list[tuple[int, int]], base: int, found: dict[int, list[tuple[int, int, int, int]]]) -> None:
        """Adds the matches of one stretch, whose first word is the row's word `base`, template by template."""
        for at, (state, length) in enumerate(trace):
            if length < LEAST_MATCH or (at + 1 < len(trace) and trace[at + 1][1] == length + 1):
                continue
            while state > 0 and length >= LEAST_MATCH:
                for k, ends in self.ends[state].items():
                    for end in ends:
                        if end - length + 1 >= 0:
                            found.setdefault(k, []).append((base + at - length + 1, base + at, end - length + 1, end))
                state = self.link[state]
                length = min(length, self.size[state]) if state >= 0 else 0

    def spans(self, matches: dict[int, list[tuple[int, int, int, int]]]) -> list[Span]:
        """Chains of a row's matches that cover their template and their part of the document well enough.

        A match may end several chains: one that covers more is kept beside one that starts later."""
        out = []
        for k, found in matches.items():
            n = len(self.texts[k])
            least = 1.0 if n <= SHORT_TEMPLATE else COVER
            reach = n // 4 + 1
            near: list[tuple[int, int, int, int]] = []  # covered, first, last, last in template
            for a, b, c, d in sorted(set(found)):
                near = [x for x in near if a - x[2] <= reach]  # a later match starts no earlier
                ways = [(b - a + 1, a)]
                for covered, first, last, end in near:
                    skip = max(0, last + 1 - a, end + 1 - c)
                    if d > end and b > last and b - a + 1 > skip and least * (b - first + 1) <= n:
                        ways.append((covered + b - a + 1 - skip, first))
                latest = -1
                for covered, first in sorted(ways, reverse=True):
                    if first > latest:
                        latest = first
                        near.append((covered, first, b, d))
                        cover = covered / max(n, b - first + 1)
                        if cover >= least:
                            out.append(Span(self.labels[k], first, b, min(1.0, cover)))
        return sorted(set(out))


class Scanner:
    """Streams the stretches of each text that can match."""

    def __init__(self, templates=None, phrases=None):
        self.automaton = LicenseAutomaton(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
        spelled = pa.array([w.decode() for w in self.automaton.ids], pa.large_string())
        words = Words(*text_buffers(spelled), ALNUM_LOWER)
        order = np.argsort(words.hash)
        self.hash, self.id = words.hash[order], order.astype(np.int64)
        n = len(self.automaton.ids)
        self.pairs = np.array(sorted(a * n + b for a, b in self.automaton.pairs), dtype=np.int64)

    def stretches(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(row, first word within the row, word ids) of the longest runs of known pairs."""
        if not len(words.hash) or not len(self.hash):
            return
        place = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        ids = np.where(self.hash[place] == words.hash, self.id[place], -1)
        both = (ids[:-1] >= 0) & (ids[1:] >= 0) & (words.row[:-1] == words.row[1:])
        pair = np.zeros(len(ids) + 1, dtype=bool)
        pair[1:-1][both] = np.isin(ids[:-1][both] * len(self.id) + ids[1:][both], self.pairs)
        starts = np.flatnonzero(pair[1:] & ~pair[:-1])
        stops = np.flatnonzero(~pair[1:] & pair[:-1]) + 1
        for a, b in zip(starts, stops, strict=True):
            row = int(words.row[a])
            yield row, int(a - words.first[row]), ids[a:b].tolist()

    def scan(self, words: Words) -> list[tuple[list[tuple[str, int]], list[Span]]]:
        """(phrase places, spans) of each row."""
        places: list[list[tuple[str, int]]] = [[] for _ in words.n_words]
        matches: list[dict[int, list[tuple[int, int, int, int]]]] = [{} for _ in words.n_words]
        for row, at, ids in self.stretches(words):
            trace = list(self.automaton.stream(ids))
            places[row].extend((label, at + first) for label, first in self.automaton.phrase_places(trace))
            self.automaton.matches(trace, at, matches[row])
        return [(x, self.automaton.spans(y) if y else []) for x, y in zip(places, matches, strict=True)]


_SCANNED = ("id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
            "labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>")


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: counts and places of the phrases, labels of phrases and spans, best coverage, the spans."""
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffers(part.column("text")), ALNUM_LOWER)
                out = []
                for places, spans in scanner.scan(words):
                    base = {x for x, _ in places}
                    firsts = [at for _, at in places]
                    out.append((
                        len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base)),
                        ",".join(sorted(base | {s.label for s in spans})),
                        1.0 if places else max((s.cover for s in spans), default=0.0), [s._asdict() for s in spans]))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words.n_words, pa.int64()),
                     *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _SCANNED).withColumnRenamed("id", id_col)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All templates and phrases over the whole documents table."""
    return scanned(documents(spark, sf_dir)).drop("spans")
