"""Operator 6: licence scans by sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a file, and every block of neighbouring lines made mostly of words that templates have too, is compared with
the templates: term counts weighted by inverse document frequency, cosine of the sparse vectors. Document frequencies of
the template terms are counted over all files; a term that no template has counts as never seen elsewhere, so it only
lengthens the vector of the line. The best match of at least ``threshold`` is the file's own licence.

A licence found in a licence file (by its name) holds for its directory and all below that have no nearer one: directories
are joined with the licence directories on each of their ancestors, and the deepest wins. A file's own licence comes first.

Null texts count as empty. Rows with a null path have their own licence only. Of several licence files in one directory
the best score counts, then the smaller path. Repeated rows come back once each. Other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Common notices of well-known licences, by identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
}
LICENCE_FILE = r"(?i)^(LICEN[CS]E|COPYING|NOTICE)"
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")
BLOCK_SHARE = 0.7


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def document_frequencies(files: DataFrame, vocabulary: frozenset[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and of those that have each template term; the vocabulary bounds what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += 1
                df.update(vocabulary.intersection(terms(text or "")))
        yield pa.RecordBatch.from_pydict({"term": ["", *df], "n": [total, *df.values()]})

    rows = files.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop("", 0), found


class Matcher:
    def __init__(self, templates: dict[str, list[str]], files: int, df: dict[str, int]):
        self.weight = {t: math.log((1 + files) / (1 + df.get(t, 0))) + 1 for group in templates.values() for text in group for t in terms(text)}
        self.unseen = math.log(1 + files) + 1
        self.vectors = []
        for name in sorted(templates):
            for text in templates[name]:
                v = {t: n * self.weight[t] for t, n in Counter(terms(text)).items()}
                self.vectors.append((name, v, math.sqrt(sum(x * x for x in v.values()))))

    def best(self, words: list[str], least: float) -> tuple[float, str] | None:
        """Score and name of the nearest template, if it reaches ``least``; ties go to the first name."""
        own, other = {}, 0.0
        for t, n in Counter(words).items():
            w = self.weight.get(t)
            if w is None:
                other += n * n
            else:
                own[t] = n * w
        known = sum(x * x for x in own.values())
        length = math.sqrt(known + other * self.unseen * self.unseen)
        if not own or math.sqrt(known) < least * length * (1 - 1e-12):  # the cosine can't exceed the share of known terms
            return None
        top = None
        for name, v, norm in self.vectors:
            s = sum(x * v[t] for t, x in own.items() if t in v) / (norm * length)
            if top is None or s > top[0] + 1e-12:
                top = (s, name)
        return top if top[0] >= least else None

    def scan(self, text: str, least: float) -> tuple[float, str] | None:
        """The best match of the lines and blocks of a whole text."""
        top, block = None, []
        for line in [*text.split("\n"), ""]:
            words = terms(line)
            tries = [words] if words else []
            if words and sum(w in self.weight for w in words) >= BLOCK_SHARE * len(words):
                block.append(words)
            else:
                if len(block) > 1:
                    tries.append([w for part in block for w in part])
                block = []
            for t in tries:
                got = self.best(t, least)
                if got and (top is None or got[0] > top[0] + 1e-12):
                    top = got
        return top


def own_licences(files: DataFrame, *, path_col: str = "path", text_col: str = "text", key_col: str = "doc_id", templates: dict | None = None, threshold: float = 0.8) -> DataFrame:
    """``key``, ``path``, ``own`` and ``own_score`` of every file."""
    templates = templates or TEMPLATES
    vocabulary = frozenset(t for group in templates.values() for text in group for t in terms(text))
    matcher = Matcher(templates, *document_frequencies(files, vocabulary, text_col))
    rows = files.select(F.col(key_col).alias("key"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                got = [matcher.scan(t or "", threshold) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("path"), pa.array([g and g[1] for g in got], pa.string()), pa.array([g and min(1.0, g[0]) for g in got], pa.float64())], names=["key", "path", "own", "own_score"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("path", T.StringType()), T.StructField("own", T.StringType()), T.StructField("own_score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def inherit(found: DataFrame) -> DataFrame:
    """Adds ``licence``, ``score``, ``origin`` (``own``, ``inherited`` or null) and ``origin_path`` to files with ``path``, ``own``, ``own_score``."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = found.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    holders = files.where(name.rlike(LICENCE_FILE) & F.col("own").isNotNull()).groupBy("folder").agg(
        F.max("own_score").alias("top"), F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own")).alias("best"))
    holders = holders.select(F.col("folder").alias("holder"), F.col("best.own").alias("held"), F.col("top").alias("held_score"), F.col("best.path").alias("held_path"))
    parts = F.split("folder", "/")
    # '' is the root; a/b has the ancestors a/b, a and ''
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.select("folder").where("folder is not null").distinct().withColumn("holder", F.explode(F.array_distinct(ancestors)))
    nearest = folders.join(holders, "holder").groupBy("folder").agg(F.max_by(F.struct("held", "held_score", "held_path"), F.length("holder")).alias("from"))
    joined = files.join(nearest, "folder", "left")
    has, near = F.col("own").isNotNull(), F.col("from").isNotNull()
    return joined.select("key", "path", F.coalesce("own", "from.held").alias("licence"), F.when(has, F.col("own_score")).otherwise(F.col("from.held_score")).alias("score"),
                         F.when(has, "own").when(near, "inherited").alias("origin"), F.when(has, F.col("path")).otherwise(F.col("from.held_path")).alias("origin_path"))
