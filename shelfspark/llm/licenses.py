"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

Text and templates are lower-cased (A-Z) and split at everything ASCII that is neither letter nor digit; other characters
belong to words. A template with s shingles (of SHINGLE words, or of all its words if it has fewer) is looked for in
windows of 2s shingles, one each s shingles, so that any s shingles in a row lie within one window. A window that holds at
least CONTAINED of a template's shingles has a Jaccard similarity of at least CONTAINED/(3-CONTAINED) = 0.36 with it; with
BANDS bands of one row each, one of them agrees with a probability of 1 - (1-0.36)^BANDS > 0.9999. Windows that agree in
a band are compared with the template exactly, word by word; overlapping finds of one template are one span.

Narrow: no shuffle; the templates are fixed, and no larger for larger inputs.

Edge cases: null and empty texts have no finds; repeated rows are scanned each by itself; other columns pass through, and
an input column with the name of the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.packed import spread

# Notices of public licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "Proprietary": ["All rights reserved."],
}

SHINGLE, CONTAINED, BANDS, SEED = 5, 0.8, 24, 11
#: Words of documents that are scanned at once, and hashes of words that a worker keeps.
WORDS_AT_ONCE, CACHE_ENTRIES = 400_000, 1_000_000
#: Maps A-Z to a-z and ASCII other than letters and digits to a space, byte by byte.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
FIND = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("containment", T.DoubleType())])
FIND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("containment", pa.float64())]))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(PLAIN).split()


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of the shingle that starts at each word; there are width - 1 fewer of them than words."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return spread(out)


class Template:
    def __init__(self, name: str, text: str, cache: WordHashes):
        self.name, words = name, words_of(text)
        self.width = min(SHINGLE, len(words))
        self.shingles = {tuple(words[i : i + self.width]) for i in range(len(words) - self.width + 1)}
        self.step = len(words) - self.width + 1
        self.hashes = np.unique(shingle_hashes(np.array([cache[w] for w in words], dtype=np.uint64), self.width))


class Scanner:
    def __init__(self, templates: dict[str, list[str]], bands: int = BANDS, contained: float = CONTAINED):
        self.cache, self.contained = WordHashes(), contained
        self.templates = [Template(name, t, self.cache) for name, texts in templates.items() for t in texts]
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(0, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.groups: dict[int, dict[int, list[Template]]] = {}
        for t in self.templates:
            self.groups.setdefault(t.width, {}).setdefault(t.step, []).append(t)

    def scan(self, docs: list[list[bytes]]) -> list[list[tuple[str, int, int, float]]]:
        """Of each document the finds: license, first word, word after the last, containment."""
        finds: list[list] = [[] for _ in docs]
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        hashes = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(docs)), dtype=np.uint64, count=int(lengths.sum()))
        for width, steps in self.groups.items():
            shingles = shingle_hashes(hashes, width)
            if not len(shingles):
                continue
            # Shingles that run over the end of a document belong to none.
            over = np.concatenate([np.arange(max(0, f + n - width + 1), f + n) for f, n in zip(first, lengths, strict=True)])
            valid = np.ones(len(shingles), dtype=bool)
            valid[over[over < len(shingles)]] = False
            hit = {t: np.zeros(-(-len(shingles) // t.step), dtype=bool) for ts in steps.values() for t in ts}
            for factor in self.factors:
                mixed = np.where(valid, shingles * factor, NONE)
                for step, ts in steps.items():
                    least = np.minimum.reduceat(mixed, np.arange(0, len(mixed), step)) if step > 1 else mixed
                    both = least.copy()
                    both[:-1] = np.minimum(least[:-1], least[1:])
                    for t in ts:
                        hit[t] |= both == (t.hashes * factor).min()
            for t, windows in hit.items():
                for at in np.flatnonzero(windows) * t.step:
                    self._confirm(t, int(at), docs, first, lengths, finds)
        return [self._merged(f) for f in finds]

    def _confirm(self, t: Template, at: int, docs: list, first: np.ndarray, lengths: np.ndarray, finds: list) -> None:
        """Compare the window's shingles with the template's, in each document that the window touches."""
        end = at + 2 * t.step
        d = int(np.searchsorted(first, at, side="right")) - 1
        while d < len(docs) and first[d] < end:
            a, b = max(at - int(first[d]), 0), min(end - int(first[d]), int(lengths[d]) - t.width + 1)
            if a < b:
                words = docs[d]
                found = [(i, s) for i in range(a, b) if (s := tuple(words[i : i + t.width])) in t.shingles]
                share = len({s for _, s in found}) / len(t.shingles)
                if share >= self.contained:
                    finds[d].append((t.name, found[0][0], found[-1][0] + t.width, share))
            d += 1

    @staticmethod
    def _merged(finds: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        out: list[list] = []
        for name, a, b, share in sorted(finds):
            if out and out[-1][0] == name and a < out[-1][2]:
                out[-1][2:] = max(b, out[-1][2]), max(share, out[-1][3])
            else:
                out.append([name, a, b, share])
        return [tuple(x) for x in sorted(out, key=lambda x: (x[1], x[0], x[2]))]


def character_spans(text: str, finds: list[tuple[str, int, int, float]]) -> list[dict]:
    """Word numbers to characters of the text."""
    if not finds:
        return []
    data = text.encode("utf-8", "replace")
    spans = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(PLAIN))]
    at = lambda n: len(data[:n].decode("utf-8"))
    return [{"license": name, "start": at(spans[a][0]), "stop": at(spans[b - 1][1]), "containment": share} for name, a, b, share in finds]


def scan_licenses(df: DataFrame, text: str = "text", out: str = "licenses", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Add `out`, an array of (license, start, stop, containment) in characters of the text."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for whole in batches:
            texts = whole.column(whole.num_columns - 1).to_pylist()
            found, docs, held = [], [], 0

            def flush(docs: list) -> list:
                got = scanner.scan(docs)
                if len(scanner.cache) > CACHE_ENTRIES:
                    scanner.cache.clear()
                return got

            for t in texts:
                docs.append(words_of(t))
                held += len(docs[-1])
                if held >= WORDS_AT_ONCE:
                    found += flush(docs)
                    docs, held = [], 0
            found += flush(docs) if docs else []
            column = pa.array([character_spans(t or "", f) for t, f in zip(texts, found, strict=True)], FIND_ARROW)
            yield pa.RecordBatch.from_arrays([whole.column(i) for i in range(len(keep))] + [column], names=[*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(FIND))])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
