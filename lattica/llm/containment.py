"""Short items inside long texts: MinHash over windows, then exact shingle containment.

Items are partitioned by their number of shingles. For a partition of up to U shingles a text is cut
into blocks of U, and every two neighbouring blocks are a window of 2U, so a passage of up to U
shingles lies whole in a window. That bounds the Jaccard similarity of an item and the window that
contains it from below, and the number of bands follows from this bound and the wanted probability.
Retrieved pairs are checked exactly: the share of the item's distinct shingles in the whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from math import ceil, log
from pathlib import Path

import numpy as np
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, keep_only, kept, map_rows, mix64, scratch, shingle_hashes, slices, spread, texts_of

_HASHES = (mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).tolist()


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of `rows` hashes so that a pair of this similarity is missed with at most this probability."""
    return max(1, ceil(log(miss) / log(1 - similarity**rows)))


class SizePartition:
    def __init__(self, upper: int, lower: int, items: list[int], sets: list[np.ndarray], threshold: float, rows: int, miss: float):
        self.upper, self.rows = upper, rows
        self.least = threshold * lower
        self.bands = self.bands_of(upper, lower, threshold, rows, miss)
        self.tables = []
        for b in range(self.bands):
            keys = np.array([self.key([int(((s * np.uint64(a)) >> np.uint64(32)).min()) for a in self.odd(b)])[0] for s in sets], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], np.array(items)[order]))

    @staticmethod
    def bands_of(upper: int, lower: int, threshold: float, rows: int, miss: float) -> int:
        shared = threshold * lower
        return bands_for(shared / (2 * upper + lower - shared), rows, miss)

    def odd(self, band: int) -> list[int]:
        return _HASHES[band * self.rows : (band + 1) * self.rows]

    @staticmethod
    def key(minima):
        """One number for a band's minima (arrays, or plain numbers for one set)."""
        out = np.zeros(1, np.uint64)
        for m in minima:
            out = out * np.uint64(0x9FB21C651E98DF25) + np.asarray(m, np.uint64)
        return out

    def candidates(self, shingles: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a band in some window."""
        # a text of fewer shingles than an item has to share holds none
        long = np.flatnonzero(counts >= self.least * (1 - 1e-9))
        shingles, counts = shingles[np.repeat(counts >= self.least * (1 - 1e-9), counts)], counts[long]
        blocks = -(-counts // self.upper)
        doc = np.repeat(np.arange(len(counts)), blocks)
        if not len(doc):
            return set()
        first = np.cumsum(blocks) - blocks
        at = (np.cumsum(counts) - counts)[doc] + (np.arange(len(doc)) - first[doc]) * self.upper
        last = np.append(doc[1:] != doc[:-1], True)
        out = set()
        for b in range(self.bands):
            minima = []
            for a in self.odd(b):
                m = np.minimum.reduceat((shingles * np.uint64(a)) >> np.uint64(32), at)
                minima.append(np.where(last, m, np.minimum(m, np.append(m[1:], m[-1:]))))
            keys, (known, items) = self.key(minima), self.tables[b]
            lo = np.searchsorted(known, keys)
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == keys)
            for i in hit.tolist():
                j = int(lo[i])
                while j < len(known) and known[j] == keys[i]:
                    out.add((int(long[doc[i]]), int(items[j])))
                    j += 1
        return out


class ContainmentIndex:
    """items: (id, text). Items of fewer than k words are looked up exactly, as one run of their words; items without words never match."""

    #: Shingles that one index may hold, and so what is sent to a task; larger item sets take several passes.
    MAX_SHINGLES = 2_000_000

    def __init__(self, items: Iterable[tuple[int, str]], k: int = 5, threshold: float = 0.8, rows: int = 1, miss: float = 1e-6):
        self.k, self.threshold = k, threshold
        items = sorted(((i, t or "") for i, t in items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [i for i, _ in items]
        words, counts = WordHasher().words([t for _, t in items])
        ends = np.cumsum(counts)
        self.sets: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        sized: dict[int, list[int]] = {}
        named: list[int] = []
        for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
            own = words[end - n : end]
            self.sets.append(np.unique(shingle_hashes(own, np.array([n]), k)[0]))
            if 0 < n < k:
                self.short.setdefault(n, {}).setdefault(int(shingle_hashes(own, np.array([n]), n)[0][0]), []).append(i)
            elif n >= k:
                c, own = (n - k + 1 - 1).bit_length(), len(self.sets[i])
                # of few distinct shingles for its length, such as one word repeated: too unlike its window for bands
                few = 8 * own < 1 << c or SizePartition.bands_of(1 << c, own, threshold, rows, miss) * rows > len(_HASHES)
                (named if few else sized.setdefault(c, [])).append(i)
        self.named = [(self.sets[i], i) for i in named]
        if len(items) > 1 and sum(map(len, self.sets)) > self.MAX_SHINGLES:
            raise ValueError("too many shingles for one index")
        self.partitions = []
        for c, own in sorted(sized.items()):
            lower = min(len(self.sets[i]) for i in own)
            self.partitions.append(SizePartition(1 << c, lower, own, [self.sets[i] for i in own], threshold, rows, miss))

    def search(self, texts: list[str], hasher: WordHasher) -> list[tuple[int, int, float]]:
        """(place of the text, item id, containment) of all matches, in order."""
        words, counts = hasher.words(texts)
        shingles, n = shingle_hashes(words, counts, self.k)
        found = set()
        for p in self.partitions:
            found |= p.candidates(shingles, n)
        out, ends = [], np.cumsum(n)
        for want, i in self.named:
            found |= {(int(d), i) for d in np.searchsorted(ends, np.flatnonzero(np.isin(shingles, want)), side="right")}
        for d, i in sorted(found):
            own, want = shingles[ends[d] - n[d] : ends[d]], self.sets[i]
            share = float(np.isin(want, own).mean())
            if share >= self.threshold:
                out.append((d, self.ids[i], share))
        for size, known in self.short.items():
            runs, n = shingle_hashes(words, np.asarray(counts), size)
            whose = np.repeat(np.arange(len(n)), n)
            enough = np.repeat(counts >= size, n)
            hit = np.isin(runs, np.array(list(known), np.uint64)) & enough
            out += sorted({(int(d), self.ids[i], 1.0) for d, r in zip(whose[hit].tolist(), runs[hit].tolist()) for i in known[r]})
        return sorted(out, key=lambda x: (x[0], x[1] is None, x[1] or 0))


class IndexFile:
    """An index in the shared folder: what a task needs of it is its path; a worker keeps the last one it read."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> ContainmentIndex:
        def read() -> ContainmentIndex:
            fs, name = FileSystem.from_uri(self.path)
            with fs.open_input_file(name) as f:
                return pickle.loads(f.read())

        keep_only("containment")
        return kept("containment", self.path, read)

    @classmethod
    def write(cls, index: ContainmentIndex, path: str) -> IndexFile:
        fs, name = FileSystem.from_uri(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name) as f:
            f.write(pickle.dumps(index))
        return cls(path)


def index_batches(items: DataFrame, id_col: str, text_col: str, **options) -> list[ContainmentIndex | IndexFile]:
    """The items as indexes of a bounded number of shingles each. A single one is returned as it is and goes with the
    function that searches it; of more, each is written to the shared folder before the next is made.

    Null and empty texts match nothing; an item without an id is found under a null one; repeated items are found repeatedly.
    """
    spark, out, own, size, hasher = items.sparkSession, [], [], 0, WordHasher()
    folder = None
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = int(hasher.words([r.t or ""])[1][0]) + 1
        if own and size + n > ContainmentIndex.MAX_SHINGLES // 4:
            folder = folder or scratch(spark, "indexes")
            out.append(IndexFile.write(ContainmentIndex(own, **options), f"{_uri(folder)}/{len(out)}"))
            own, size = [], 0
        own.append((r.i, r.t))
        size += n
    last = ContainmentIndex(own, **options)
    return [*out, IndexFile.write(last, f"{_uri(folder)}/{len(out)}")] if out else [last]


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _loaded(index: ContainmentIndex | IndexFile) -> ContainmentIndex:
    return index.load() if isinstance(index, IndexFile) else index


def find_items(docs: DataFrame, indexes: list[ContainmentIndex | IndexFile], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, containment: a row for every text and item whose containment reaches the threshold.

    Null texts count as empty and match nothing; texts of any length are searched whole; repeated rows give repeated
    matches, a null doc_id is kept; an empty table of texts or of items gives an empty result. No text leaves its task;
    the texts are read once for each index.
    """

    def run_for(source: ContainmentIndex | IndexFile):
        def run(batches):
            hasher, index = WordHasher(), _loaded(source)
            for b in batches:
                found = index.search(b["text"], hasher)
                yield {"doc_id": [b["doc_id"][d] for d, _, _ in found], "item_id": [i for _, i, _ in found], "containment": [s for _, _, s in found]}

        return run

    rows = spread(texts_of(docs, id_col, text_col))
    parts = [map_rows(rows, run_for(x), "doc_id long, item_id long, containment double", rows=128, owner="containment") for x in indexes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, indexes: list[ContainmentIndex | IndexFile], text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that hold no item; decided row by row, without a join. Null and empty texts hold
    none and stay, as does every repeated row of a text that holds none; an empty table gives an empty result."""
    import pyarrow as pa

    def run_for(source: ContainmentIndex | IndexFile):
        def run(batches):
            keep_only("containment")
            hasher, index = WordHasher(), _loaded(source)
            for batch in batches:
                for b in slices(batch, 128):
                    texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                    keep = np.ones(len(texts), bool)
                    keep[[d for d, _, _ in index.search(texts, hasher)]] = False
                    yield b.filter(pa.array(keep))

        return run

    for x in indexes:
        docs = docs.mapInArrow(run_for(x), docs.schema)
    return docs


#: Notices by which texts name their licence.
LICENSE_NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-library-notice": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "AGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    # no licence but the claim that there is none; of fewer than k words, so found as these very words
    "all-rights-reserved": "All rights reserved.",
}

#: Whole texts of licences, each named by its file.
LICENSE_TEXTS = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 5, threshold: float = 0.8, rows: int = 1, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment: a row for every text and template that it holds. Templates are a parameter; nulls and empty texts match nothing.
    Texts of any length are searched whole; repeated rows give repeated results, a null doc_id is kept; an empty table gives an empty result."""
    templates = LICENSE_NOTICES | LICENSE_TEXTS if templates is None else templates
    names = sorted(templates)
    index = ContainmentIndex(list(enumerate(templates[n] for n in names)), k=k, threshold=threshold, rows=rows, miss=miss)
    found = find_items(docs, [index], id_col, text_col)
    return found.select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") + 1).cast("int")).alias("license"), "containment")
