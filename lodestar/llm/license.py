"""License scans: texts and notices of public licenses, found by MinHash bands of windows and verified by containment.

Words are runs of letters and digits, lower-cased. A template is a set of shingles: of one word below 15 words, of two below 40,
of three in whole license texts, so that an edited word costs a small share. A match is a stretch, a quarter longer than the
template at most, that holds at least 0.8 of the template's shingles and all words that name the license: without these a
notice would be that of another license or version. A copy with more words put in than that quarter is not found.

Templates of one shingle width and of sizes within a factor of two are retrieved together. A text is cut into overlapping
windows, twice as long as the longest match and half a window apart, so each match lies whole in one. Of a window's shingles
those that are in any template of the group are kept and sketched by BANDS minima under as many orders. Each minimum is a band of
one row, looked up in a table of the templates' minima. A window that holds a match has at most 5 times the template's
shingles, so its Jaccard similarity with the template is at least 0.8 / 5.2 and none of 128 bands collides with a probability
below 1e-9. Templates retrieved for a window are verified there by their exact shingles.

Overlapping matches of one license are one. A match goes if another license matches there that is named by the same words and
more. Null and empty texts have no matches. Of two equally good places in a stretch the first counts. Texts of any length are
scanned whole, in memory that grows with their words. Repeated rows are scanned one by one; other columns are ignored; no rows
give none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, struct, texts_of

SHARE = 0.8
BANDS = 128
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Template:
    """name: words of the text that a match must have."""

    license: str
    text: str
    name: str = ""


# Notices of public licenses; the whole texts are in the folder licenses.
NOTICES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    Template("Apache-2.0", "Apache License 2.0", "apache license 2"),
    Template("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2"),
    Template("MIT", "Released under the MIT License.", "mit"),
    Template("MIT", "Licensed under the MIT License.", "mit"),
    Template("MIT", "MIT License", "mit license"),
    Template("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    Template("GPL-3.0", "GNU General Public License version 3", "gnu general public 3"),
    Template("GPL-3.0", "GNU General Public License v3.0", "gnu general public v3"),
    Template("GPL-3.0", "GNU GPL version 3", "gpl 3"),
    Template("GPL-3.0", "licensed under the GPLv3", "gplv3"),
    Template("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu general public 3"),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    Template("GPL-2.0", "GNU General Public License version 2", "gnu general public 2"),
    Template("GPL-2.0", "GNU General Public License v2.0", "gnu general public v2"),
    Template("GPL-2.0", "GNU GPL version 2", "gpl 2"),
    Template("GPL-2.0", "licensed under the GPLv2", "gplv2"),
    Template("GPL-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu general public 2"),
    Template("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", "gnu lesser general public 3"),
    Template("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1", "gnu lesser general public 2 1"),
    Template("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla public 2"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2"),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4"),
    Template("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial 4"),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4"),
    Template("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "commons attribution 4"),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("BSD-2-Clause", "BSD 2-Clause License", "bsd 2 clause"),
    Template("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause"),
    Template("ISC", "ISC License", "isc license"),
)


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    """The notices, an SPDX line of each license, and the whole texts."""
    files = sorted((f for f in resources.files("lodestar.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    whole = tuple(Template(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files)
    names = sorted({t.license for t in NOTICES + whole} - {"BSD", "MIT-grant"})
    tags = [f"SPDX-License-Identifier: {n}" for n in names]
    return NOTICES + tuple(Template(n, t, t) for n, t in zip(names, tags, strict=True)) + whole


def words_of(text: str) -> list[str]:
    low = text.lower()
    if len(low) == len(text):
        return _WORD.findall(low)
    return [w.lower() for w in _WORD.findall(text)]


def width_of(words: list[str]) -> int:
    return 1 if len(words) < 15 else 2 if len(words) < 40 else 3


class Group:
    """Templates that are retrieved from the same windows."""

    def __init__(self, scanner: Scanner, width: int, members: list[int]) -> None:
        self.width, self.members = width, members
        self.known = np.unique(np.concatenate([scanner.sets[i] for i in members]))
        self.of = np.stack([np.isin(self.known, scanner.sets[i]) for i in members], 1)
        self.step, self.least = max(scanner.lengths[i] for i in members), min(scanner.needs[i] for i in members)
        self.bands = np.arange(BANDS)
        r = np.random.default_rng(len(self.known))
        #: The place of each known shingle in each band's order.
        self.place = np.argsort(r.random((len(self.known), BANDS)), 0).astype(np.int32)
        #: Which members have the shingle at that place as their minimum.
        self.table = np.zeros((BANDS, len(self.known), len(members)), bool)
        for j in range(len(members)):
            self.table[np.arange(BANDS), self.place[self.of[:, j]].min(0), j] = True
        self.any = self.table.any(2)
        #: For each shingle of the width, its number here, or -1.
        every = scanner.known[width]
        near = np.minimum(np.searchsorted(self.known, every), len(self.known) - 1)
        self.number = np.where(self.known[near] == every, near, -1)

    def retrieved(self, hit: np.ndarray, at: np.ndarray):
        """(member, [(first hit, end)]): windows whose sketch shares a band with the member's, those that overlap as one.

        Windows of fewer hits than the smallest match has are passed over, as no member can be verified there.
        """
        block, low = np.unique(hit // self.step, return_index=True)
        high = np.append(low[1:], len(hit))
        # A window is a block and the one after it; the block before the first one of a run begins a window too.
        after = np.minimum(np.arange(len(block)) + 1, len(block) - 1)
        joined = block[after] == block + 1
        end = np.where(joined, high[after], high)
        full = np.flatnonzero(end - low >= self.least)
        if not len(full):
            return
        wanted = np.unique(np.concatenate([full, after[full]]))
        parts = np.empty((len(block), BANDS), np.int32)
        for k in range(0, len(wanted), 1024):
            own = wanted[k : k + 1024]
            counts = high[own] - low[own]
            first = np.cumsum(counts) - counts
            rows = np.repeat(low[own] - first, counts) + np.arange(counts.sum())
            parts[own] = np.minimum.reduceat(self.place[at[rows]], first, axis=0)
        candidates = np.zeros((len(full), len(self.members)), bool)
        for k in range(0, len(full), 1024):
            w = full[k : k + 1024]
            minima = np.where(joined[w, None], np.minimum(parts[w], parts[after[w]]), parts[w])
            n, band = np.nonzero(self.any[self.bands, minima])
            np.logical_or.at(candidates, k + n, self.table[band, minima[n, band]])
        for j in np.flatnonzero(candidates.any(0)):
            ranges: list[list[int]] = []
            for w in full[candidates[:, j]].tolist():
                x, y = int(low[w]), int(end[w])
                if ranges and x <= ranges[-1][1]:
                    ranges[-1][1] = max(y, ranges[-1][1])
                else:
                    ranges.append([x, y])
            yield j, ranges


class Scanner:
    def __init__(self, wanted: tuple[Template, ...]) -> None:
        lists = [words_of(t.text) for t in wanted]
        self.licenses = [t.license for t in wanted]
        self.names = [frozenset(words_of(t.name)) for t in wanted]
        self.widths = [width_of(x) for x in lists]
        self.id_of = {w: i for i, w in enumerate(sorted(set().union(*lists)), 1)}  # 0: in no template
        keys = [self._keys(self._ids(x), w) for x, w in zip(lists, self.widths, strict=True)]
        self.sets = [np.unique(k) for k in keys]
        self.lengths = [len(k) + max(len(k) // 4, 1) for k in keys]
        self.needs = [int(np.ceil(SHARE * len(s) - 1e-9)) for s in self.sets]
        classes = [(w, len(x).bit_length()) for w, x in zip(self.widths, self.sets, strict=True)]
        #: All shingles of a width, looked up once for the groups of that width.
        self.known = {w: np.unique(np.concatenate([x for x, v in zip(self.sets, self.widths, strict=True) if v == w])) for w in set(self.widths)}
        self.groups = [Group(self, width, [i for i, c in enumerate(classes) if c == (width, size)]) for width, size in sorted(set(classes))]

    def _ids(self, words: list[str]) -> np.ndarray:
        get = self.id_of.get
        return np.array([get(w, 0) for w in words], np.int64)

    def _keys(self, ids: np.ndarray, width: int) -> np.ndarray:
        """One number per shingle; 0 if one of its words is in no template."""
        n = max(len(ids) - width + 1, 0)
        key, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            key = key * (len(self.id_of) + 1) + ids[i : i + n]
            whole &= ids[i : i + n] > 0
        return key * whole

    def __call__(self, text: str) -> list[dict]:
        words = words_of(text) if text else []
        if not words:
            return []
        ids, found, there, keys_of = self._ids(words), [], None, {}
        for group in self.groups:
            width = group.width
            if width not in keys_of:
                keys, every = self._keys(ids, width), self.known[width]
                places = np.flatnonzero(keys)
                near = np.minimum(np.searchsorted(every, keys[places]), len(every) - 1)
                same = every[near] == keys[places]
                keys_of[width] = places[same], near[same]
            hit, at = keys_of[width]
            if len(hit) < group.least:
                continue
            at = group.number[at]
            hit, at = hit[at >= 0], at[at >= 0]
            if len(hit) < group.least:
                continue
            for j, ranges in group.retrieved(hit, at):
                t = group.members[j]
                there = there or set(words)
                if self.names[t] <= there:
                    for low, high in ranges:
                        mine = np.flatnonzero(group.of[at[low:high], j]) + low
                        found += [(a, b + width, share, t) for a, b, share in self._windows(t, hit[mine].tolist(), at[mine].tolist(), words)]
        return self._merged(found, text)

    def _windows(self, t: int, places: list[int], shingles: list[int], words: list[str]):
        """(first place, last place, share) of matches that do not overlap: from where a window holds enough to where it holds most."""
        width, name, need, length = self.widths[t], self.names[t], self.needs[t], self.lengths[t]
        out, low, counts, best = [], 0, {}, None
        r = 0
        while r <= len(places):
            if best and (r == len(places) or places[r] >= best[3] + length):
                _, a, b, _ = best
                inside = shingles[a : b + 1]
                while inside.count(shingles[a]) > 1:
                    inside.pop(0)
                    a += 1
                while inside.count(shingles[b]) > 1:
                    inside.pop()
                    b -= 1
                out.append((places[a], places[b], best[0] / len(self.sets[t])))
                low, counts, r, best = best[2] + 1, {}, best[2] + 1, None
                continue
            if r == len(places):
                break
            counts[shingles[r]] = counts.get(shingles[r], 0) + 1
            while places[r] - places[low] >= length:
                counts[shingles[low]] -= 1
                if not counts[shingles[low]]:
                    del counts[shingles[low]]
                low += 1
            if len(counts) >= need and (not best or len(counts) > best[0]) and (not name or name <= set(words[places[low] : places[r] + width])):
                best = (len(counts), low, r, best[3] if best else places[low])
            r += 1
        return out

    def _merged(self, found, text: str) -> list[dict]:
        if not found:
            return []
        named = sorted(x for x in found if self.names[x[3]])
        starts, reach = [x[0] for x in named], max((x[1] - x[0] for x in named), default=0)
        over = lambda x: (y for y in named[bisect_left(starts, x[0] - reach) : bisect_left(starts, x[1])] if y[1] > x[0])
        kept = [x for x in found if not self.names[x[3]] or not any(self.names[x[3]] < self.names[y[3]] and self.licenses[x[3]] != self.licenses[y[3]] for y in over(x))]
        out: list[list] = []
        last: dict[str, list] = {}
        for a, b, share, t in sorted(kept):
            m = last.get(self.licenses[t])
            if m and a < m[1]:
                m[1], m[2] = max(m[1], b), max(m[2], share)
            else:
                last[self.licenses[t]] = m = [a, b, share, self.licenses[t]]
                out.append(m)
        spans = [m.span() for m in _WORD.finditer(text)]
        return [{"license": n, "start": spans[a][0], "end": spans[b - 1][1], "share": float(share)} for a, b, share, n in sorted(out, key=lambda m: (m[0], m[3]))]


def scan(docs: DataFrame, wanted: tuple[Template, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches array<struct<license, start, end, share>>, one row per text; offsets in characters of the text."""
    scanner = Scanner(wanted or templates())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, lambda b: {"doc_id": b.column("doc_id"), "matches": [scanner(t) for t in texts_of(b)]}, struct(f"doc_id {docs.schema[id_col].dataType.simpleString()}, matches array<struct<license:string,start:int,end:int,share:double>>"))
