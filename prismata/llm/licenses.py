"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts become token sequences (words without punctuation and case). Of the hashes of each three consecutive tokens,
winnowing keeps the least of each two, in templates and documents alike; the templates' fingerprints are an inverted
index. A document's stretch around fingerprints that may be in the index (a bitmap tells) goes through
the exact join with the index; a template that shares enough fingerprints is aligned with the stretch: local alignment
in a band around the diagonal that most shared three-token windows vote for. Aligned tokens are then masked and the
template is tried again, so that each occurrence is found. Documents without such a stretch never leave the scan.

Templates are whole license texts (``license_texts``), notices of all versions and siblings, and opening terms. Those
of more than SHORT tokens have a bitmap and stretches of their own, which need as many likely hits as the least of
them asks for. Versions and variants count: an aligned stretch may hold no version or variant word that its template
does not hold, and with a short template exactly the same ones. Where occurrences in a text overlap, the one with the
most matched tokens stays (then the highest coverage, then the first license_id).

Defined results: null and empty texts have no license; a template of fewer than three tokens is never found; rows
without a doc_id are not reported; rows that repeat a doc_id each report their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.llm.bitmap import bitmap, passes
from prismata.plans.shared import materialize

GRAM, WINNOW, BAND, COVERAGE, SHARED, SHORT = 3, 2, 8, 0.8, 0.3, 64
# fixed values: words that tell variants of a license apart, and words before a version in whole texts
VARIANTS = "lesser library affero documentation noncommercial noderivatives noderivs sharealike bync bysa bynd byncsa byncnd nc nd sa".split()
BEFORE = "version v license".split()
# fixed values: notices and opening terms of public licenses
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT-notice": "Released under the MIT License.",
    "MIT-terms": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
_CC = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
    for _short, _long in _CC.items():
        _kind = {"4.0": "International", "3.0": "Unported"}.get(_v, "Generic")
        TEMPLATES.setdefault(f"CC-BY{_short}-{_v}-notice", f"This work is licensed under a Creative Commons Attribution{_long} {_v} {_kind} License.")
        TEMPLATES[f"CC-BY{_short}-{_v}-short-notice"] = f"Licensed under CC BY{_short} {_v}."
TEMPLATES["CC-BY-NC-4.0-full-notice"] = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
del TEMPLATES["CC-BY-NC-4.0-short-notice"]  # the notice above
_GNU = {"GPL": ("General Public License", "1 2 3"), "LGPL": ("Lesser General Public License", "2.1 3"), "AGPL": ("Affero General Public License", "1 3"), "GFDL": ("Free Documentation License", "1.1 1.2 1.3")}
for _id, (_name, _versions) in [*_GNU.items(), ("LGPL", ("Library General Public License", "2"))]:
    for _v in _versions.split():
        _full = _v if "." in _v else f"{_v}.0"
        TEMPLATES.setdefault(f"{_id}-{_full}-notice", f"This work is licensed under the GNU {_name}, version {_v}.")
        if _full != _v:
            TEMPLATES[f"{_id}-{_full}-point-notice"] = f"This work is licensed under the GNU {_name}, version {_full}."
        if _id != "GFDL":
            TEMPLATES.setdefault(f"{_id}-{_full}-header", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version.")
            TEMPLATES[f"{_id}-{_full}-only-header"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name} as published by the Free Software Foundation, version {_v} of the License."
for _id, _name, _versions in (("Apache", "Apache License", "1.0 1.1"), ("MPL", "Mozilla Public License", "1.0 1.1 2.0"), ("EPL", "Eclipse Public License", "1.0 2.0"), ("BSL", "Boost Software License", "1.0"), ("Artistic", "Artistic License", "1.0 2.0")):
    for _v in _versions.split():
        TEMPLATES[f"{_id}-{_v}-notice"] = f"Licensed under the {_name}, Version {_v}."
for _id, _name in (("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("CC0-1.0", "CC0 1.0 Universal")):
    TEMPLATES[f"{_id}-notice"] = f"Released under the {_name}."
TEMPLATES["MPL-2.0-header"] = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
# whole texts: the terms without appendices that tell how to apply them
TEMPLATES |= {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license_id string, text string")


def _tokens(col: pa.Array) -> tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the indices of those that are tokens, their hashes and rows."""
    w = tx.words(col, fold=True)
    at = np.flatnonzero(w.hash)
    return w, at, w.hash[at], w.row[at]


def _marks(w: tx.Words, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per token: 2 for a variant word or a number after a word of BEFORE, 1 for another short word with a digit."""
    digits = np.r_[0, np.cumsum((w.data >= 0x30) & (w.data <= 0x39))]
    number = (digits[w.end[at]] > digits[w.start[at]]) & (w.end[at] - w.start[at] <= 8)
    variant, before = (np.isin(h, tx.words(pa.array([" ".join(x)]), fold=True).hash) for x in (VARIANTS, BEFORE))
    follows = np.r_[False, before[:-1] & (w.row[at][1:] == w.row[at][:-1])] if len(h) else before
    return np.where(variant | (number & follows), 2, number.astype(int)).astype(np.int32)


def _fingerprints(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and token index of the kept fingerprints."""
    g = tx.grams(h, GRAM)
    at = np.flatnonzero(tx.inside(row, GRAM))
    at = at[tx.winnow(g[at], row[at], WINNOW)]
    return g[at], at


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch):
            w, word, h, row = _tokens(part.column("text"))
            f, at = _fingerprints(h, row)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("license_id"), tx.lists(tx.signed(f), np.bincount(row[at], minlength=n) if len(at) else np.zeros(n, int), pa.int64()), *[tx.lists(x, np.bincount(row, minlength=n) if len(row) else np.zeros(n, int), kind) for x, kind in ((tx.signed(h), pa.int64()), (_marks(w, word, h), pa.int32()))]],
                names=["license_id", "prints", "template", "marks"],
            )


def _stretches(tiers: list[tuple[np.ndarray, int, int]]):
    """(doc_id, text key, tier, stretch id, fingerprints, tokens, marks, first and last+1 code point of each token)
    around likely hits. A tier is a bitmap, the reach around a hit, and the least number of hits in a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                w, word, h, row = _tokens(part.column("text"))
                prints, places = _fingerprints(h, row)
                count = np.bincount(row, minlength=part.num_rows)
                first = np.cumsum(count) - count
                point = marks = k1 = None
                for tier, (bits, reach, least) in enumerate(tiers):
                    hit = passes(bits, prints)
                    f, at = prints[hit], places[hit]
                    if len(at) < least:
                        continue
                    lo = np.maximum(at - reach, first[row[at]])
                    hi = np.minimum(at + GRAM + reach, first[row[at]] + count[row[at]])
                    new = np.r_[True, lo[1:] >= np.maximum.accumulate(hi)[:-1]]
                    group = np.cumsum(new) - 1
                    lo, hi, hits = lo[new], np.maximum.reduceat(hi, np.flatnonzero(new)), np.bincount(group)
                    enough = hits >= least
                    if not enough.any():
                        continue
                    f, lo, hi, hits = f[enough[group]], lo[enough], hi[enough], hits[enough]
                    sizes = hi - lo
                    take = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
                    if point is None:
                        point, marks, (k1, _) = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)], _marks(w, word, h), tx.sequence_key(w)
                    base = np.repeat(point[w.offsets[row[lo]]], sizes)
                    ident = tx.mix(k1[row[lo]] ^ tx.mix(lo.astype(np.uint64) - first[row[lo]].astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(row[lo])),
                            pa.array(tx.signed(k1[row[lo]])),
                            pa.array(np.full(len(lo), tier, np.int32)),
                            pa.array(tx.signed(ident)),
                            tx.lists(tx.signed(f), hits, pa.int64()),
                            tx.lists(tx.signed(h[take]), sizes, pa.int64()),
                            tx.lists(marks[take], sizes, pa.int32()),
                            tx.lists((point[w.start[word[take]]] - base).astype(np.int32), sizes, pa.int32()),
                            tx.lists((point[w.end[word[take]]] - base).astype(np.int32), sizes, pa.int32()),
                        ],
                        names=["doc_id", "key", "tier", "stretch", "prints", "tokens", "token_marks", "starts", "ends"],
                    )

    return run


def fits(template: list[int], marks: list[int], tokens: list[int], token_marks: list[int]) -> bool:
    """Whether aligned ``tokens`` name no other version or variant than the template: none that it lacks and, if the
    template is short, exactly its own (there any number may be a version)."""
    if len(template) > SHORT:
        own = set(template)
        return all(t in own for t, m in zip(tokens, token_marks, strict=True) if m == 2)
    return Counter(t for t, m in zip(template, marks, strict=True) if m) == Counter(t for t, m in zip(tokens, token_marks, strict=True) if m)


def align(template: list[int], tokens: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment within ``band`` of ``tokens[i + diagonal] ~ template[i]`` (match 2, else -1): matched
    tokens, first and last+1 token index."""
    best = (0, 0, 0, 0)
    width = 2 * band + 1
    row = [(0, 0, 0)] * width  # score, matches, first token
    for i, t in enumerate(template):
        now = []
        for d in range(width):
            j = i + diagonal + d - band
            if not 0 <= j < len(tokens):
                now.append((0, 0, j + 1))
                continue
            s, m, a = row[d] if row[d][0] else (0, 0, j)
            same = tokens[j] == t
            cell = (s + 2, m + 1, a) if same else (s - 1, m, a)
            if d and now[d - 1][0] - 1 > cell[0]:
                cell = (now[d - 1][0] - 1, *now[d - 1][1:])
            if d + 1 < width and row[d + 1][0] - 1 > cell[0]:
                cell = (row[d + 1][0] - 1, *row[d + 1][1:])
            if cell[0] <= 0:
                cell = (0, 0, j + 1)
            if cell[0] > best[0]:
                best = (*cell, j + 1)
            now.append(cell)
        row = now
    return best[1], best[2], best[3]


def occurrences(template: list[int], marks: list[int], tokens: list[int], token_marks: list[int], band: int, coverage: float) -> list[tuple[int, int, int]]:
    """All alignments (matched, first, last+1) of a template that reach the coverage and fit, best diagonal first."""
    places: dict[tuple, list[int]] = {}
    for i in range(len(template) - GRAM + 1):
        places.setdefault(tuple(template[i : i + GRAM]), []).append(i)
    tokens, out = list(tokens), []
    while True:
        vote = Counter(j - i for j in range(len(tokens) - GRAM + 1) for i in places.get(tuple(tokens[j : j + GRAM]), ()))
        found = False
        while vote and not found:
            diagonal = max(vote, key=lambda d: (vote[d], -d))
            m, a, b = align(template, tokens, diagonal, band)
            if m >= coverage * len(template):
                if fits(template, marks, tokens[a:b], token_marks[a:b]):
                    out.append((m, a, b))
                tokens[a:b] = [0] * (b - a)  # 0 is no token's hash
                found = True
            else:
                vote = Counter({d: n for d, n in vote.items() if abs(d - diagonal) > band})
        if not found:
            return out


def _align(band: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for m, a, b in occurrences(r["template"], r["marks"], r["tokens"], r["token_marks"], band, coverage):
                    out.append((r["doc_id"], r["key"], r["license_id"], m, len(r["template"]), m / len(r["template"]), r["starts"][a], r["ends"][b - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "key", *_FOUND])

    return run


MOST_SENT = 500_000  # chosen stretches that are broadcast, about 40 bytes each
_FOUND = ["license_id", "n_matched", "n_tokens", "coverage", "span_start", "span_end"]


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the overlapping occurrences of a text those with the most matched tokens; equal rows stand or fall together."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            kept: list[tuple] = []
            for x, n in sorted(Counter(tuple(f[c] for c in _FOUND) for f in r["found"]).items(), key=lambda y: (-y[0][1], -y[0][3], y[0][0], y[0][4])):
                if all(x[5] <= k[4] or k[5] <= x[4] for k in kept):
                    kept.append(x)
                    out += [(r["doc_id"], *x)] * n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", *_FOUND])


def scan(docs: DataFrame, licenses: DataFrame | None = None, text: str = "text", band: int = BAND, coverage: float = COVERAGE, shared: float = SHARED) -> DataFrame:
    """``(doc_id, license_id, n_matched, n_tokens, coverage, span_start, span_end)`` per occurrence; spans in code
    points, end exclusive."""
    licenses = templates(docs.sparkSession) if licenses is None else licenses
    index = licenses.select("license_id", F.col("text").cast("string").alias("text")).mapInArrow(_index, "license_id string, prints array<long>, template array<long>, marks array<int>")
    index = materialize(index.withColumn("tier", (F.size("template") > SHORT).cast("int")), "license-index")
    needed = F.greatest(F.lit(1), F.ceil(F.size(F.array_distinct("prints")) * shared))
    bounds = {r["tier"]: (r["most"] + band, r["least"]) for r in index.where("size(prints) > 0").groupBy("tier").agg(F.max(F.size("template")).alias("most"), F.min(needed).alias("least")).collect()}
    entries = index.select("license_id", "tier", F.explode(F.array_distinct("prints")).alias("h"), needed.alias("needed"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    tiers = [(bitmap(entries.where(F.col("tier") == t)), *bounds.get(t, (band, 1))) for t in (0, 1)]
    found = "doc_id long, key long, license_id string, n_matched int, n_tokens int, coverage double, span_start int, span_end int"
    parts = materialize(texts.mapInArrow(_stretches(tiers), "doc_id long, key long, tier int, stretch long, prints array<long>, tokens array<long>, token_marks array<int>, starts array<int>, ends array<int>"), "stretches")
    hits = parts.select("doc_id", "tier", "stretch", F.explode(F.array_distinct("prints")).alias("h")).distinct().join(entries, ["tier", "h"])
    chosen = hits.groupBy("doc_id", "tier", "stretch", "license_id", "needed").count().where(F.col("count") >= F.col("needed"))
    # few stretches are chosen: where these are few enough to send, the tokens of all others need no exchange
    chosen = materialize(chosen.select("doc_id", "tier", "stretch", "license_id"), "chosen-stretches")
    sent = F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen
    pairs = parts.drop("prints").join(sent, ["doc_id", "tier", "stretch"]).join(index.select("license_id", "template", "marks"), "license_id")
    each = pairs.select("doc_id", "key", "license_id", "template", "marks", "tokens", "token_marks", "starts", "ends").mapInArrow(_align(band, coverage), found)
    texts_found = each.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*_FOUND)).alias("found"))
    return texts_found.mapInArrow(_best, found.replace("key long, ", ""))
