"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

A window of n bigrams and a template of m have the coefficient 2k / (n + m),
where k is the size of the multiset of bigrams that both have. At least t asks
for n between m * t / (2 - t) and m * (2 - t) / t, and for k of t * m / (2 - t)
or more; both bounds prune templates before any window is counted. Windows may
lie anywhere in the text, so a notice is found inside a long document too.
Templates are notices and whole license texts; those of long licenses are read
from a folder, whose path is a parameter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm import textkernel as K
from strandmap.llm.common import free_name, lean, ship, text_slices
from strandmap.llm.license_texts import TEXTS

U64 = np.uint64

# Notices by which works name their licenses. What stands before a slash names the license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD/reference": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL/notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT/notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved.",
} | TEXTS


def folder_templates(folder: str) -> dict[str, str]:
    """Templates from a folder of license texts, one a file, named after its license; links are passed over."""
    files = (p for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink())
    return {f"{p.name}/text": p.read_text(encoding="utf-8", errors="replace") for p in files}


def license_of(template: F.Column) -> F.Column:
    """The license that a template stands for."""
    return F.substring_index(template, "/", 1)


# Bytes that separate words once text is normalised: all ASCII but letters, digits and the point within numbers.
_GAP = np.ones(256, bool)
_GAP[128:] = False
for _range in (range(48, 58), range(65, 91), range(97, 123)):
    _GAP[list(_range)] = False
_SLICE = 1_000_000


def _bigrams(data: np.ndarray, offsets: np.ndarray):
    """(row, hash) of each pair of neighbouring words of a row, in order."""
    rows, starts, lengths = K.word_spans(data, offsets, _GAP)
    words = K.span_hashes(data, starts, lengths)
    same = rows[1:] == rows[:-1]
    return rows[1:][same], K.mix(words[:-1] * U64(3) + words[1:])[same], np.flatnonzero(same), (starts, lengths)


@dataclass
class Templates:
    names: list[str]
    bigrams: list[np.ndarray]  # sorted, repeats kept
    least: float

    @property
    def all(self) -> np.ndarray:
        return np.unique(np.concatenate(self.bigrams)) if self.bigrams else np.zeros(0, U64)


def prepare(templates: dict[str, str] | None = None, least: float = 0.8) -> Templates:
    """Normalise the templates; those of fewer than two words can't match and are left out."""
    names, grams = [], []
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        data, offsets = K.flat(pa.array([text]))
        _, g, _, _ = _bigrams(data, offsets)
        if len(g):
            names.append(name)
            grams.append(np.sort(g))
    return Templates(names, grams, least)


def best_window(places: np.ndarray, grams: np.ndarray, template: np.ndarray, least: float) -> tuple[float, int, int]:
    """The best coefficient of a window of a text with one template, and the window's first and last bigram.

    places and grams: where the text has bigrams of the template. The best
    window starts and ends at one of them, as others only add to its size. Ties
    go to the first, then to the shorter window. A start is tried only if the
    bigrams behind it can beat the best window so far.
    """
    m = len(template)
    longest = math.floor(m * (2 - least) / least + 1e-9)
    need = math.ceil(m * least / (2 - least) - 1e-9)
    if len(places) < need:
        return 0.0, 0, 0
    values, stock = np.unique(template, return_counts=True)
    kind = np.searchsorted(values, grams)
    if np.minimum(np.bincount(kind, minlength=len(values)), stock).sum() < need:
        return 0.0, 0, 0  # too few shared bigrams in the whole text
    # A bigram of a window counts unless the window has used up the template's stock of its kind.
    order = np.argsort(kind, kind="stable")
    nth = np.empty(len(kind), np.int64)
    nth[order] = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
    before = np.zeros(len(values), np.int64)
    ends = np.searchsorted(places, places + longest)
    best = (0.0, 0, 0)
    for i in range(len(places) - need + 1):
        j = int(ends[i])
        if j - i >= need and 2 * min(j - i, m) / (min(j - i, m) + m) > best[0]:
            counts = nth[i:j] - before[kind[i:j]] < stock[kind[i:j]]
            k = np.cumsum(counts)
            d = np.where(counts & (k >= need), 2 * k / (places[i:j] - places[i] + 1 + m), 0.0)
            at = int(d.argmax())
            if d[at] > best[0]:
                best = (float(d[at]), int(places[i]), int(places[i + at]))
        before[kind[i]] += 1
    return best if best[0] >= least else (0.0, 0, 0)


def scan_bytes(t: Templates, data: np.ndarray, offsets: np.ndarray):
    """(row, template, coefficient, first byte, last byte + 1) of each template found in a row."""
    rows, grams, word, (starts, lengths) = _bigrams(data, offsets)
    known = t.all
    if not len(known) or not len(grams):
        return
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hit = np.flatnonzero(known[at] == grams)
    if not len(hit):
        return
    place = np.arange(len(grams)) - np.searchsorted(rows, rows)
    cuts = [0, *(np.flatnonzero(np.diff(rows[hit])) + 1).tolist(), len(hit)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h = hit[a:b]
        first = h[0] - place[h[0]]
        for i, template in enumerate(t.bigrams):
            mine = h[np.isin(grams[h], template)]
            score, x, y = best_window(place[mine], grams[mine], template, t.least)
            if score:
                w, z = word[first + x], word[first + y] + 1
                row = int(rows[h[0]])
                yield row, i, score, int(starts[w] - offsets[row]), int(starts[z] + lengths[z] - offsets[row])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text if None) and matches: an array of (license, dice, begin, end).

    Each template appears once, with its best window; begin and end are byte
    places in the text's UTF-8. Words are compared without regard to case,
    punctuation and white space. Matches come from the best to the worst, ties
    by name. Null, empty and one-word texts have none. Rows stay as they are,
    repeated ones and those with null ids too; a column named matches is
    replaced, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    t = prepare(templates, least)
    others = [c for c in (docs.columns if keep is None else keep) if c not in ("matches", text)]
    match = T.ArrayType(T.StructType().add("license", "string").add("dice", "double").add("begin", "long").add("end", "long"))
    schema = T.StructType([docs.schema[c] for c in others]).add("matches", match)
    arrow = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = K.flat(batch.column(len(others)))
            for a, b in text_slices(np.diff(offsets), _SLICE):
                part = offsets[a : b + 1]
                found = [[] for _ in range(b - a)]
                for row, i, score, x, y in scan_bytes(t, data[part[0] : part[-1]], part - part[0]):
                    found[row].append({"license": t.names[i], "dice": score, "begin": x, "end": y})
                for f in found:
                    f.sort(key=lambda m: (-m["dice"], m["license"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(others))), pa.array(found, arrow)], names=[*others, "matches"])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias(free_name(docs, "_text"))).mapInArrow(lean(run), schema)
