"""License scans by diagonal voting.

Hashes of all runs of k words of all texts are joined with the places of the
same runs in license templates.  Matches of one template on one diagonal (place
in the text less place in the template) are counted, neighbouring diagonals are
merged, so that words put in or left out don't break a span, and a span is
verified by the share of its template's words that its matches cover in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import LOWER_TABLE
from .words import NOT_LETTERS, signed, words_of

K = 4
#: Diagonals this near one another belong to one span.
NEAR = 3
#: Share of a template's words that a span must cover.
LEAST = 0.6

# The base phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices that texts carry, with the labels that the method gives.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "GNU Lesser General Public License",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by": "This work is licensed under a Creative Commons Attribution",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def _words(texts: list[bytes]):
    return words_of([t.translate(LOWER_TABLE) for t in texts], NOT_LETTERS)


def template_places(spark, k: int = K, templates: dict[str, str] | None = None) -> DataFrame:
    """(hash, template, at, words): every run of k words of every template; as many rows as the templates have words."""
    rows = []
    for name, text in (templates or TEMPLATES).items():
        words = _words([text.encode()])
        grams, whole = words.grams(k)
        rows += [(int(h), name, i, len(grams)) for i, (h, ok) in enumerate(zip(signed(grams), whole, strict=True)) if ok]
    return spark.createDataFrame(rows, "hash long, template string, at int, words int")


def _phrases() -> list[tuple[np.ndarray, list[bytes], str]]:
    return [(_words([p.encode()]).hashes, p.encode().split(), label) for p, label in PHRASES.items()]


def scan_rows(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: row, doc_id, base results, and ``hashes``: a mark, then the hash of every run of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases()
        for part, texts in slices(batches):
            words = _words([t.encode() for t in texts])
            grams, whole = words.grams(k)
            per_text = np.diff(words.first)
            end_of = np.repeat(words.first[1:], per_text)
            of = words.text_of_word()
            n_base = np.zeros(len(texts), np.int64)
            low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
            labels: list[set[str]] = [set() for _ in texts]
            for hashes, spelt, label in phrases:
                at = np.flatnonzero(words.hashes == hashes[0])
                at = at[at + len(hashes) <= end_of[at]]
                for i in range(1, len(hashes)):
                    at = at[words.hashes[at + i] == hashes[i]]
                at = at[np.array([all(words.word(j + i) == w for i, w in enumerate(spelt)) for j in at.tolist()], bool)]
                doc = of[at]
                place = at - words.first[doc]
                np.add.at(n_base, doc, 1)
                np.minimum.at(low, doc, place)
                np.maximum.at(high, doc, place)
                for d in np.unique(doc).tolist():
                    labels[d].add(label)
            none = high < 0
            runs = np.maximum(per_text - k + 1, 0)
            sizes = runs + 1
            ends = np.cumsum(sizes)
            values = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
            mask = np.ones(len(values), bool)
            mask[ends - sizes] = False
            values[mask] = signed(grams[whole])
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(per_text), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(x)) for x in labels]), hashes],
                ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "hashes"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, hashes array<bigint>")


def votes(scanned: DataFrame, places: DataFrame) -> DataFrame:
    """One row per text that has its matches in ``found``: (template, words, diagonal, places in the template)."""
    base = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    each = scanned.select("row", F.struct(*base).alias("base"), F.posexplode("hashes").alias("i", "hash"))
    # The mark of a text comes first and is kept whether it matches or not.
    hits = each.join(F.broadcast(places), "hash", "left").where((F.col("i") == 0) | F.col("template").isNotNull())
    marked = hits.select(
        "row",
        F.when(F.col("i") == 0, F.col("base")).alias("base"),
        F.when(F.col("i") > 0, F.struct("template", "words", (F.col("i") - 1 - F.col("at")).alias("diagonal"))).alias("on"),
        F.when(F.col("i") > 0, F.col("at")).alias("at"),
    )
    diagonals = marked.groupBy("row", "on").agg(F.max("base").alias("base"), F.collect_set("at").alias("places"))
    return diagonals.groupBy("row").agg(
        F.max("base").alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("on").isNotNull(), F.struct("on.template", "on.diagonal", "on.words", "places")))).alias("found"),
    )


def merged_spans(found: list[dict], k: int, near: int, least: float) -> list[tuple[str, int, int, float]]:
    """(template, first word, end, share covered) of the verified spans, from one text's diagonals in order.

    Neighbouring diagonals of a template are one span; its matches count where
    text and template both go forward.
    """
    spans = []
    i = 0
    while i < len(found):
        j, group = i + 1, [found[i]]
        while j < len(found) and found[j]["template"] == found[i]["template"] and found[j]["diagonal"] - group[-1]["diagonal"] <= near:
            group.append(found[j])
            j += 1
        words = found[i]["words"]
        matches = sorted((at, at + d["diagonal"]) for d in group for at in d["places"])
        # Far copies of a template lie on other diagonals; within a group each run of forward matches is one copy.
        copies: list[list[tuple[int, int]]] = []
        for at, place in sorted(matches, key=lambda m: (m[1], m[0])):
            if copies and at > copies[-1][-1][0] and place > copies[-1][-1][1]:
                copies[-1].append((at, place))
            elif not copies or place > copies[-1][-1][1]:
                copies.append([(at, place)])
        for copy in copies:
            covered = np.zeros(words, bool)
            for at, _ in copy:
                covered[at : at + k] = True
            share = float(covered.mean())
            if share >= least:
                spans.append((found[i]["template"], copy[0][1], copy[-1][1] + k, share))
        i = j
    return spans


def license_scan(docs: DataFrame, k: int = K, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and characters
    beyond ASCII.  ``labels`` are the base labels and those of templates of which
    a verified span covers at least ``least``; ``score`` is 1 with a base phrase,
    else the best share covered (0 without).  ``spans`` are (template, first word,
    end, share).

    A null or empty text has no words, no places and a score of 0.  Repeated
    rows come out as often as they occur; a null doc_id stays null; an empty
    table gives no rows.  Further columns are ignored.
    """
    counted = votes(scan_rows(docs, k), template_places(docs.sparkSession, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, spans = [], [], []
            for base, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = merged_spans(found or [], k, near, least)
                spans.append([{"template": t, "first": a, "stop": b, "share": s} for t, a, b, s in own])
                labels.append(",".join(sorted({*(x for x in base.split(",") if x), *(t for t, *_ in own)})))
                scores.append(1.0 if base else max((s for *_, s in own), default=0.0))
            kept = [batch.column(i) for i in range(2, 8)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(_SPAN))], [*batch.schema.names[2:8], "labels", "score", "spans"])

    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    wide = counted.select(F.col("base.base_labels").alias("own"), "found", *(F.col(f"base.{c}").alias(c) for c in columns))
    return wide.mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<template:string,first:bigint,stop:bigint,share:double>>",
    )


_SPAN = pa.struct([("template", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])
