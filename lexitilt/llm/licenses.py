"""License scans by patience alignment of texts with notice templates.

A place of a document is compared with a template where enough of the template's words stand
close together. There the two word sequences are aligned: words that are unique in both are
anchors, the longest increasing run of anchors is kept, and the gaps before, between and after
them are aligned the same way; a gap without such a word is closed word by word from both ends.
Coverage is the share of the template's words that are aligned. A notice is found where
coverage reaches ``min_coverage`` and all words that name the license are among the aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")
MIN_COVERAGE = 0.75

#: License, the words that name it, notice text.
TEMPLATES = (
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "permission free software",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "gnu general license 3",
     "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general license 2",
     "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general free 3",
     "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "licensed cc by nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "licensed cc by sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "licensed cc by 4.0", "Licensed under CC BY 4.0."),
    ("Apache-2.0", "apache license 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache license 2.0",
     "Licensed under the Apache License, Version 2.0; you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "redistribution source binary",
     "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct ``values``."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        before[k] = ends[at - 1] if at else -1
        tails[at:at + 1] = [v]
        ends[at:at + 1] = [k]
    out: list[int] = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (place in text, place in template) pairs, increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(text[a:b], a) if in_text[w] == 1}
        anchors = [(place[w], k) for k, w in enumerate(template[c:d], c)
                   if in_template[w] == 1 and w in place]
        kept = [anchors[k] for k in longest_increasing([x for x, _ in anchors])]
        if kept:
            pairs += kept
            edges = [(a - 1, c - 1), *kept, (b, d)]
            gaps += [(x + 1, y, p + 1, q) for (x, p), (y, q) in zip(edges, edges[1:])]
            continue
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
    return sorted(pairs)


class Scanner:
    """Templates as words, with the numbers that tell where an alignment is worth making."""

    def __init__(self, templates=TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.min_coverage = min_coverage
        self.templates = [(name, set(must.split()), words_of(text))
                          for name, must, text in templates]
        names = sorted({w for _, _, ws in self.templates for w in ws})
        self.number = {w: k + 1 for k, w in enumerate(names)}
        self.member = np.zeros((len(self.templates), len(names) + 1), np.int64)
        for t, (_, _, ws) in enumerate(self.templates):
            self.member[t, [self.number[w] for w in ws]] = 1

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each notice, by place."""
        words = words_of(text)
        if not words:
            return []
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return []
        present = set(np.unique(ids).tolist())
        found: list[tuple[int, str, float, int, int]] = []
        for t, (name, must, ws) in enumerate(self.templates):
            if not all(self.number[w] in present for w in must):
                continue
            m = len(ws)
            width = min(len(words), m + m // 2)
            sums = np.concatenate(([0], np.cumsum(self.member[t][ids])))
            close = sums[width:] - sums[:-width] if width < len(words) else sums[-1:]
            starts = np.nonzero(close >= self.min_coverage * m)[0].tolist()
            done = -1
            while starts:
                start = next((s for s in starts if s > done), None)
                if start is None:
                    break
                # the window may begin before the notice: align from here to a length beyond
                window = words[start:start + width + m // 2]
                pairs = patience(window, ws)
                coverage = len({c for _, c in pairs}) / m
                if coverage >= self.min_coverage and must <= {ws[c] for _, c in pairs}:
                    first, last = start + pairs[0][0], start + pairs[-1][0]
                    found.append((len(pairs), name, round(coverage, 6), first, last))
                    done = last
                else:
                    done = start
                starts = [s for s in starts if s > done]
        # of notices that overlap, the one with most words aligned, then the fuller
        kept: list[tuple[str, float, int, int]] = []
        for _, *x in sorted(found, key=lambda x: (-x[0], -x[2], x[1], x[3])):
            if all(x[2] > y[3] or x[3] < y[2] for y in kept):
                kept.append(tuple(x))
        return sorted(kept, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  templates=TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_notices, notices; one row a document.

    ``notices`` lists license, coverage, first_word and last_word of each notice in order;
    ``license`` and ``coverage`` are those of the fullest, the first of equals. A null or
    empty text, or one without a notice, has null, null, 0 and an empty list. Repeated rows
    give repeated results; an empty table gives no rows; other columns are not used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            found = [scanner.scan(t) for t in batch["text"]]
            best = [max(f, key=lambda x: x[1]) if f else (None, None, 0, 0) for f in found]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "license": [b[0] for b in best],
                "coverage": pd.Series([b[1] for b in best], dtype="float64"),
                "n_notices": [len(f) for f in found],
                "notices": [[{"license": a, "coverage": b, "first_word": c, "last_word": d}
                             for a, b, c, d in f] for f in found]})

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text")) \
        .mapInPandas(run, "doc_id string, license string, coverage double, n_notices int, notices "
                          "array<struct<license:string,coverage:double,first_word:int,"
                          "last_word:int>>")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
