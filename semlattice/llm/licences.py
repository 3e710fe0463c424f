"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds all runs of tokens of all templates. A file is streamed through it
once; after each token the state and the match length say the longest run that ends here
and stands in some template (matching statistics). Only stretches of template tokens are
streamed: a token that no template has resets the automaton in any case. Locally longest
matches of enough tokens are chained, in the order of file and template, into covered
template spans; a template whose span is covered well enough gives its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import small_batches, table

#: Phrases whose every place counts, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public licence notices, in words as the scan takes them; (label, text).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)


@dataclass
class Automaton:
    """Generalised suffix automaton over token ids; state 0 is the start."""

    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    phrases: list[tuple[int, ...]] = field(default_factory=list)

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(dict(go))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.go) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, self.go[q], self.link[q])
        self.link[q] = copy
        while p >= 0 and self.go[p].get(token) == q:
            self.go[p][token] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, token: int) -> int:
        """The state of the text so far and the token; texts are added one after another from state 0."""
        q = self.go[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.go[p]:
            self.go[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def finish(self, texts: list[list[int]]) -> None:
        """Notes for each state where its runs end, as (text, place), from longer runs to their suffixes."""
        for t, text in enumerate(texts):
            state = 0
            for place, token in enumerate(text):
                state = self.go[state][token]
                self.ends[state].add((t, place))
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """After each token: the state and the length of the longest match that ends there."""
        state = matched = 0
        for token in tokens:
            while state and token not in self.go[state]:
                state = self.link[state]
                matched = self.length[state]
            if token in self.go[state]:
                state, matched = self.go[state][token], matched + 1
            yield state, matched


@dataclass(frozen=True)
class Scan:
    """min_match: shortest match that is chained. gap: unmatched template or file tokens between chained matches.

    cover: share of a template's tokens that a chain must cover to give its label; short_cover: of templates
    with fewer than `short` tokens. One of the chain's matches must stand in templates of that label only, or
    be the whole template: words that notices have in common give no label.
    """

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    min_match: int = 3
    gap: int = 8
    cover: float = 0.6
    short: int = 10
    short_cover: float = 0.8


class Scanner:
    """Built once in each task from the bounded template list."""

    def __init__(self, spec: Scan):
        self.spec = spec
        texts = [t.split() for _, t in spec.templates] + [p.split() for p, _ in spec.phrases]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        hashes = np.array([bw.word_hash(w) for w in vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.texts = [[vocabulary[w] for w in t] for t in texts]
        self.automaton = a = Automaton()
        for text in self.texts:
            state = 0
            for token in text:
                state = a.extend(state, token)
        a.finish(self.texts)
        first = len(spec.templates)
        #: state -> (phrase, its length), where a phrase is a suffix of the state's longest run
        self.phrase_at: list[list[tuple[int, int]]] = [[] for _ in a.go]
        for t in range(first, len(self.texts)):
            state = 0
            for token in self.texts[t]:
                state = a.go[state][token]
            self.phrase_at[state].append((t - first, len(self.texts[t])))
        for s in sorted(range(1, len(a.go)), key=a.length.__getitem__):
            self.phrase_at[s] = self.phrase_at[s] + self.phrase_at[a.link[s]]
        self.places: list[list[tuple[int, int]]] = [[(t, p) for t, p in e if t < first] for e in a.ends]
        #: state -> whether its runs stand in templates of one label only
        self.own = [len({spec.templates[t][0] for t, _ in places}) == 1 for places in self.places]
        self.shortest = min([spec.min_match, *(len(t) for t in self.texts[first:])])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Token ids of word hashes, -1 for words that no template has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def scan(self, ids: np.ndarray, first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of one stretch of template tokens that starts at word `first`: phrase places (phrase, start) and
        matches (start, end, state) that no longer match of the stretch holds."""
        found, matches = [], []
        previous = (0, 0)
        for i, (state, matched) in enumerate(self.automaton.statistics(ids.tolist())):
            if matched <= previous[1] and previous[1] >= self.spec.min_match:
                matches.append((first + i - previous[1], first + i, previous[0]))
            found += [(p, first + i - n + 1) for p, n in self.phrase_at[state] if n <= matched]
            previous = (state, matched)
        if previous[1] >= self.spec.min_match:
            matches.append((first + len(ids) - previous[1], first + len(ids), previous[0]))
        return found, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
        """Covered template spans (template, first word, end word, tokens covered, whether a match is the label's own), the matches in file order."""
        spans: dict[int, list[int]] = {}
        done = []
        for start, end, state in matches:
            for t, place in self.places[state]:
                n, open_ = end - start, spans.get(t)
                own = self.own[state] or n == len(self.texts[t])
                # [first word, end word, template end, covered, own]
                if open_ and place > open_[2] and start - open_[1] <= self.spec.gap and place - n - open_[2] <= self.spec.gap:
                    fresh = min(n, place - open_[2], end - open_[1])
                    if fresh > 0:
                        spans[t] = [open_[0], end, place, open_[3] + fresh, open_[4] or own]
                elif not open_ or start - open_[1] > self.spec.gap or n > open_[3]:
                    if open_:
                        done.append((t, open_[0], open_[1], open_[3], open_[4]))
                    spans[t] = [start, end, place, n, own]
        return done + [(t, s[0], s[1], s[3], bool(s[4])) for t, s in spans.items()]

    def row(self, ids: np.ndarray) -> dict:
        """Places, spans and labels of one file, given its words' token ids."""
        known = ids >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        places, matches = [], []
        for i, j in zip(edges[::2], edges[1::2], strict=True):
            if j - i >= self.shortest:
                found, more = self.scan(ids[i:j], int(i))
                places += found
                matches += more
        spans = self.chains(matches)
        names = [label for label, _ in self.spec.templates]
        share = [n / len(self.texts[t]) for t, _, _, n, _ in spans]
        enough = [own and x >= (self.spec.cover if len(self.texts[t]) >= self.spec.short else self.spec.short_cover) for (t, _, _, _, own), x in zip(spans, share, strict=True)]
        base = sorted({self.spec.phrases[p][1] for p, _ in places})
        starts = [s for _, s in places]
        return {
            "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base": base,
            "labels": sorted({*base, *(names[s[0]] for s, e in zip(spans, enough, strict=True) if e)}),
            "score": 1.0 if places else float(min(1.0, max(share, default=0.0))),
            "spans": [{"label": names[t], "template": t, "first_word": a, "end_word": b, "covered": n} for (t, a, b, n, _), e in zip(spans, enough, strict=True) if e],
        }


_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64())])


def licence_spans(docs: DataFrame, spec: Scan = Scan()) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one for each row of docs.

    Words: runs of digits, ASCII letters (lower-cased) and non-ASCII characters; whole texts.
    n_base: all places where a phrase's words follow each other. labels: of phrases and of
    templates covered enough, distinct, sorted, joined by commas ('' if none). score: 1 with a
    phrase, else the largest covered share of a template. Null or empty text: no words, score 0.
    doc_id may be null or repeated. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(spec)
        for batch in batches:
            for words in bw.slices(batch.column(1), bw.ALNUM):
                ids = scanner.ids(words.hashes())
                # rows without a long enough stretch of known tokens need no look
                known = np.concatenate([[0], np.cumsum(ids >= 0)])
                rows = []
                for a, b in zip(words.first, words.first[1:], strict=False):
                    rows.append(scanner.row(ids[a:b] if known[b] - known[a] >= scanner.shortest else ids[:0]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.rows.start, len(rows)), pa.array(words.counts.astype(np.int64)),
                        pa.array([r["n_base"] for r in rows], pa.int64()), pa.array([r["first_word"] for r in rows], pa.int64()), pa.array([r["last_word"] for r in rows], pa.int64()),
                        pa.array([",".join(r["base"]) for r in rows], pa.string()), pa.array([",".join(r["labels"]) for r in rows], pa.string()),
                        pa.array([r["score"] for r in rows], pa.float64()), pa.array([r["spans"] for r in rows], pa.list_(_SPAN)),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,template:int,first_word:bigint,end_word:bigint,covered:bigint>>",
    )


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the built-in templates."""
    return licence_spans(table(spark, sf_dir, "documents")).drop("spans")
