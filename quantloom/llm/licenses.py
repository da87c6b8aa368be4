"""License scans: given phrases by word positions, and text blocks that contain a license template.

The method is an exact set-similarity join. Blocks are word sets: the lines of a text for all templates and, as license
texts are broken into lines at any place, windows across lines for templates of LONG words and more: each 2 n words that
start at a multiple of n, for a template of n words, so any n words in a row are inside one. A template's set T is found
in a block B if |B n T| >= THRESHOLD |T|. Template words are ordered by their frequency in all lines, rare first
(a count over the whole corpus). A block that meets the threshold o = ceil(THRESHOLD |T|) shares one of the first
|T| - o + 1 words of T, so only blocks with such a word are joined with the templates, on that word (prefix filter);
they need o words (length filter), and behind the word enough words of both must be left (positional filter). What
remains is counted exactly.

Cases: null and empty texts have no words and no labels; identical rows get identical results; an empty table gives
an empty result; other columns are ignored. The template words are a parameter, so their tables are small at any
size of the corpus; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .spark_tools import is_small, stage, table, text_batches
from .text_kernels import ALNUM, hash_of, lists, slices, word_hashes, words

# The phrases of the query.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Characteristic sentences of well-known licenses.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
]
THRESHOLD = 0.8
#: Words of a template from which on it is looked for in windows, too; shorter ones would meet prose there.
LONG = 15


def _scan_words(batch: pa.Array) -> Iterator[tuple]:
    for lo, hi, raw, off in slices(batch):
        start, end, bounds = words(raw, off, ALNUM)
        h = word_hashes(raw, start, end)
        doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
        # a block ends at a line break and at the end of a text
        breaks = np.flatnonzero(raw == 10)
        block = np.searchsorted(breaks, start) + doc
        yield lo, hi, h, bounds, doc, block


def _places(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The index of each hash in the sorted vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, places (array of label, start word), found (array of block, template,
    label, containment). block: the number of a line from 0, or -1 - the first word of a window."""
    spark = docs.sparkSession
    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sets = [sorted(set(t.split())) for _, t in templates]
    vocabulary = np.unique(np.array([hash_of(w) for s in sets for w in s], np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, h, _, _, block in _scan_words(batch.column(0)):
                at = _places(vocabulary, h)
                total += np.bincount(np.unique(np.stack([block[at >= 0], at[at >= 0]], 1), axis=0)[:, 1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    # at most as many rows as the templates have words
    frequency = rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(vocabulary), np.int64)
    n[frequency["word"]] = frequency["n"]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, n))] = np.arange(len(vocabulary))
    ordered = [sorted(int(rank[np.searchsorted(vocabulary, np.uint64(hash_of(w)))]) for w in s) for s in sets]
    needs = [int(np.ceil(threshold * len(s) - 1e-9)) for s in sets]
    prefix = np.zeros(len(vocabulary), bool)
    for s, o in zip(ordered, needs, strict=True):
        prefix[s[: len(s) - o + 1]] = True
    least = min(needs)
    # by length: the words of prefixes, and the least that a template of this length needs
    windows = {}
    for (_, t), s, o in zip(templates, ordered, needs, strict=True):
        if (n := len(t.split())) >= LONG:
            rare, low = windows.get(n, (np.zeros(len(vocabulary), bool), o))
            rare[s[: len(s) - o + 1]] = True
            windows[n] = rare, min(low, o)
    wanted = [(np.array([hash_of(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, bounds, doc, block in _scan_words(batch.column(2)):
                m = hi - lo
                p_doc, p_at, p_label = [], [], []
                for i, (hs, _) in enumerate(wanted):
                    k = len(hs)
                    at = np.flatnonzero(h[: len(h) - k + 1] == hs[0]) if len(h) >= k else np.zeros(0, np.int64)
                    for j in range(1, k):
                        at = at[h[at + j] == hs[j]]
                    at = at[doc[at] == doc[at + k - 1]] if len(at) else at
                    p_doc.append(doc[at])
                    p_at.append(at - bounds[doc[at]])
                    p_label.append(np.full(len(at), i))
                p_doc, p_at, p_label = map(np.concatenate, (p_doc, p_at, p_label))
                by = np.lexsort((p_label, p_at, p_doc))
                p_n = np.bincount(p_doc, minlength=m)
                # blocks with a prefix word and enough template words: their template words by rank
                at = _places(vocabulary, h)
                hit = np.flatnonzero(at >= 0)
                r = rank[at[hit]]
                hot = np.unique(block[hit][prefix[r]])
                keep = hit[np.isin(block[hit], hot)]
                found = np.unique(np.stack([block[keep], rank[at[keep]]], 1), axis=0) if len(keep) else np.zeros((0, 2), np.int64)
                blocks, first, size = np.unique(found[:, 0], return_index=True, return_counts=True)
                one = np.searchsorted(block, blocks)
                of = doc[one] if len(blocks) else np.zeros(0, np.int64)
                number = blocks - (block[bounds[of]] if len(blocks) else 0)
                kinds = [(found[:, 1], first, size, least, of, number, np.zeros(len(of), np.int64))]
                # windows of each length: a word is in the one that starts at or before it and in the one before that
                place = hit - bounds[doc[hit]]
                for n, (rare, low) in windows.items():
                    code = (doc[hit] << 32) + place // n + 1
                    near = np.unique(code[rare[r]])
                    near = np.unique(np.r_[near - 1, near])
                    both = [np.stack([c, r], 1)[np.isin(c, near)] for c in (code, code - 1)]
                    found = np.unique(np.concatenate(both), axis=0)
                    found = found[(found[:, 0] & 0xFFFFFFFF) > 0]
                    blocks, first, size = np.unique(found[:, 0], return_index=True, return_counts=True)
                    kinds.append((found[:, 1], first, size, low, blocks >> 32, -1 - ((blocks & 0xFFFFFFFF) - 1) * n, np.full(len(blocks), n)))
                tokens, size, of, number, length = [], [], [], [], []
                for words_, first, n, low, *rest in kinds:
                    enough = n >= low
                    tokens += [words_[f : f + k] for f, k in zip(first[enough], n[enough], strict=True)]
                    for into, values in zip((size, of, number, length), (n, *rest), strict=True):
                        into.append(values[enough])
                size, of, number, length = map(np.concatenate, (size, of, number, length))
                order = np.argsort(of, kind="stable")
                tokens = np.concatenate([tokens[i] for i in order]) if len(order) else np.zeros(0, np.int64)
                per_doc = np.bincount(of, minlength=m)
                offsets = pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32))
                inner = pa.StructArray.from_arrays([pa.array(number[order]), pa.array(length[order]), lists(tokens, size[order], pa.int64())], ["block", "length", "words"])
                p_off = pa.array(np.r_[0, np.cumsum(p_n)].astype(np.int32))
                labels = pa.array([wanted[i][1] for i in p_label[by]], pa.string())
                p_inner = pa.StructArray.from_arrays([labels, pa.array(p_at[by])], ["label", "start"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(p_off, p_inner), pa.ListArray.from_arrays(offsets, inner)],
                    ["id", "h", "n_words", "places", "blocks"],
                )

    scanned = stage(rows.mapInArrow(scan, f"id {kind}, h long, n_words long, places array<struct<label:string,start:long>>, blocks array<struct<block:long,length:long,words:array<long>>>"))
    sides = spark.createDataFrame([(i, label, s, o, len(t.split())) for i, ((label, t), s, o) in enumerate(zip(templates, ordered, needs, strict=True))], "template int, label string, t array<long>, o int, n long")
    probes = sides.select("template", "label", "t", "o", "n", F.posexplode(F.slice("t", F.lit(1), F.size("t") - F.col("o") + 1)).alias("i", "word"))
    blocks = scanned.where("size(blocks) > 0").select("id", "h", F.explode("blocks").alias("b")).select("id", "h", "b.block", "b.length", "b.words")
    pairs = blocks.select("id", "h", "block", "length", "words", F.posexplode("words").alias("j", "word")).join(F.broadcast(probes), "word")  # the templates are a bounded parameter
    # i and j are the places of the shared word; of the words before it in the template, each may or may not be shared
    pairs = pairs.where((F.col("length") == 0) | (F.col("length") == F.col("n")))
    pairs = pairs.where((F.size("words") >= F.col("o")) & (F.least("i", "j") + F.least(F.size("t") - F.col("i"), F.size("words") - F.col("j")) >= F.col("o")))
    common = F.size(F.array_intersect("words", "t"))
    pairs = pairs.withColumn("common", common).where("common >= o")
    found = pairs.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("block", "template", "label", (F.col("common") / F.size("t")).alias("containment")))).alias("found"))
    found = stage(found).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "found")
    out = scanned.drop("blocks").join(F.broadcast(found) if is_small(found) else found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    empty = F.array().cast("array<struct<block:bigint,template:int,label:string,containment:double>>")
    return out.select(F.col("id").alias(id_col), "n_words", "places", F.coalesce("found", empty).alias("found"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("found", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda p: p["containment"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), score.alias("score"))
