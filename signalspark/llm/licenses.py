"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and its paragraphs (neighbouring lines with words). A block and a template are sets of
tokens, which are pairs of neighbouring words; the block meets the template if it holds at least THRESHOLD of its
tokens. Tokens outside all templates are in no overlap and are left out of the blocks' sets.

Tokens are ordered by how many blocks hold them, rarest first. A template of n tokens of which o are needed shares one
of its first n - o + 1 tokens with every block that meets it, and one of the first b - o + 1 of a block of b. Both
prefixes are joined on the token; b >= o is the length filter; as only tokens from the shared place on can still be
common, min(b - i, n - j) >= o is the positional one. A pair that is left is verified at its first shared token, so
once. The work is linear in the blocks: the other side is the list of templates, whose size is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import query, release, stored, table, text_slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
THRESHOLD = (3, 4)
#: Templates go to every task; more than that raises.
TEMPLATE_BYTES = 4 << 20

# The phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public notices by which licenses are commonly named, and labels for them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Vocabulary:
    """Numbers of the templates' words and word pairs."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        if sum(len(t.encode()) for _, t in templates) > TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes: scan with some of them at a time")
        self.words: dict[bytes, int] = {}
        pairs = set()
        self.sets = []
        for _, text in templates:
            own = [self.words.setdefault(w, len(self.words)) for w in words_of(text.encode())]
            self.sets.append(set(zip(own, own[1:], strict=False)))
            pairs |= self.sets[-1]
        #: Codes of all tokens in order; a token's number is its place here.
        self.codes = np.array(sorted(a * len(self.words) + b for a, b in pairs) or [-1], np.int64)

    def tokens(self, pairs: set) -> list[int]:
        return sorted(np.searchsorted(self.codes, [a * len(self.words) + b for a, b in pairs]).tolist())

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Token of each pair of word numbers, or -1."""
        code = np.where((first >= 0) & (second >= 0), first * len(self.words) + second, -2)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)


def needed(size: int) -> int:
    """Least number of shared tokens with a template of so many."""
    return -(-THRESHOLD[0] * size // THRESHOLD[1])


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[str, int]]:
    """Label and place of every phrase, by place."""
    found = []
    for phrase, label in phrases.items():
        own = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(own[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(own)] == own:
                found.append((label, at))
    return sorted(found, key=lambda f: (f[1], f[0]))


def _blocks(words: list[bytes], lines: np.ndarray, parts: np.ndarray, vocabulary: Vocabulary, least: int) -> list[dict]:
    """Blocks with at least ``least`` template tokens: words with the numbers of their line and paragraph."""
    known = vocabulary.words
    number = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
    token = vocabulary.numbers(number[:-1], number[1:])
    found = {}
    for kind, owner in enumerate((lines, parts)):
        for at in np.flatnonzero((token >= 0) & (owner[:-1] == owner[1:])).tolist():
            found.setdefault((kind, int(owner[at])), set()).add(int(token[at]))
    out, told = [], set()
    for (kind, k), own in sorted(found.items()):
        owner = (lines, parts)[kind]
        first, end = (int(np.searchsorted(owner, k, side)) for side in ("left", "right"))
        if len(own) >= least and (first, end) not in told:  # a paragraph of one line is a block once
            told.add((first, end))
            out.append({"first": first, "size": end - first, "tokens": sorted(own)})
    return out


def scan(docs: DataFrame, text: str, vocabulary: Vocabulary, phrases: dict[str, str], least: int) -> DataFrame:
    """(id, n_words, base, blocks) of every row."""
    place = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))
    block = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64()), ("tokens", pa.list_(pa.int32()))]))
    opening = {p.encode().split()[0] for p in phrases}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raws in text_slices(batch.column(1)):
                counts, base, blocks = [], [], []
                for raw in raws:
                    by_line = [WORD.findall(line) for line in raw.lower().split(b"\n")]
                    words = [w for line in by_line for w in line]
                    sizes = np.fromiter(map(len, by_line), np.int64, len(by_line))
                    counts.append(len(words))
                    base.append([{"label": x, "at": k} for x, k in phrase_places(words, phrases)] if opening & set(words) else [])
                    if len(words) < 2:
                        blocks.append([])
                        continue
                    lines = np.repeat(np.arange(len(sizes)), sizes)
                    parts = np.repeat(np.cumsum(sizes == 0), sizes)
                    blocks.append(_blocks(words, lines, parts, vocabulary, least))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(raws)), pa.array(counts, pa.int64()), pa.array(base, place), pa.array(blocks, block)],
                    names=["id", "n_words", "base", "blocks"],
                )
                at += len(raws)
        release()

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, base array<struct<label:string,at:long>>, blocks array<struct<first:long,size:long,tokens:array<int>>>"
    return docs.select("id", text).mapInArrow(scanned, schema)


def meeting_blocks(blocks: DataFrame, templates: Sequence[tuple[str, str]], vocabulary: Vocabulary) -> DataFrame:
    """Joins (row, first, size, tokens) with the templates: (row, first, size, label, share) of all that meet."""
    spark = blocks.sparkSession
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    # At most one number per token of the templates.
    held = {r["token"]: r["count"] for r in counted.collect()}
    order = sorted(range(len(vocabulary.codes)), key=lambda t: (held.get(t, 0), t))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def by_rank(tokens: pa.Array) -> pa.Array:
        return pa.array([np.sort(rank[t]) for t in tokens.to_pylist()], pa.list_(pa.int32()))

    wanted = []
    for (label, _), pairs in zip(templates, vocabulary.sets, strict=True):
        own = sorted(int(rank[t]) for t in vocabulary.tokens(pairs))
        o = needed(len(own))
        wanted += [(token, label, j, own, o) for j, token in enumerate(own[: len(own) - o + 1])]
    schema = "token int, label string, j int, wanted array<int>, o int"
    prefixes = spark.createDataFrame(wanted, schema)
    ordered = blocks.select("row", "first", "size", by_rank("tokens").alias("own"))
    each = ordered.select("*", F.posexplode("own").alias("i", "token"))
    filters = F.least(F.size("own") - F.col("i"), F.size("wanted") - F.col("j")) >= F.col("o")
    met = each.join(prefixes, "token").where(filters)
    shared = F.array_intersect("own", "wanted")
    # The shared tokens keep the order, so the first tells where the pair is counted.
    met = met.withColumn("shared", shared).where((F.col("shared")[0] == F.col("token")) & (F.size("shared") >= F.col("o")))
    return met.select("row", "first", "size", "label", (F.size("shared") / F.size("wanted")).alias("share"))


def find_licenses(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """(id, n_words, base, found) for every row of ``docs``.

    ``base``: label and place of each phrase, in words from 0. ``found``: label, first word, number of words and share
    of every block that meets a template, by place. A null or empty text has no words; rows that repeat get the same
    answer; an empty table gives no rows; texts of any length are scanned whole, a line or paragraph of any length is
    one block. Templates of fewer than two words have no tokens and are met by nothing. Other columns are not read.
    """
    vocabulary = Vocabulary(templates)
    least = min((needed(len(s)) for s in vocabulary.sets if s), default=1)
    kept = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    scanned = scan(kept, "text", vocabulary, PHRASES if phrases is None else phrases, least)
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    met = meeting_blocks(blocks, templates, vocabulary)
    found = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "size", "label", "share"))).alias("found"))
    none = F.array().cast("array<struct<first:long,size:long,label:string,share:double>>")
    both = scanned.drop("blocks").join(stored(found, "licenses"), "row", "left")
    return both.select("id", "n_words", "base", F.coalesce("found", none).alias("found"))


def _joined(labels) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _rows(pairs) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in pairs)


OP13_SQL = rf"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
lined AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS l
  FROM low),
sized AS (
  SELECT doc_id, line, regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lined),
parted AS (
  SELECT *, sum((len(w) = 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) AS part,
    coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized),
word AS (
  SELECT doc_id, line, part, before + generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS w FROM parted WHERE len(w) > 0),
pair AS (
  SELECT *, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3, lead(line) OVER d AS line2, lead(part) OVER d AS part2
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
phrase(p, label) AS (VALUES {_rows(PHRASES.items())}),
base AS (
  SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels
  FROM pair JOIN phrase ON p = concat_ws(' ', w, w2) OR p = concat_ws(' ', w, w2, w3) GROUP BY doc_id),
template(label, text) AS (VALUES {_rows(TEMPLATES)}),
tw AS (
  SELECT row_number() OVER () AS t, label, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM template),
tp AS (
  SELECT DISTINCT t, label, w[i] AS w, w[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)),
tn AS (SELECT t, count(*) AS n FROM tp GROUP BY t),
block AS (
  SELECT doc_id, 0 AS kind, line AS k, w, w2 FROM pair WHERE line = line2
  UNION SELECT doc_id, 1, part, w, w2 FROM pair WHERE part = part2),
met AS (
  SELECT doc_id, label, count(*) / max(n) AS share FROM block JOIN tp USING (w, w2) JOIN tn USING (t)
  GROUP BY doc_id, kind, k, t, label HAVING {THRESHOLD[1]} * count(*) >= {THRESHOLD[0]} * max(n)),
own AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM met GROUP BY doc_id),
total AS (SELECT doc_id, sum(len(w))::BIGINT AS n_words FROM sized GROUP BY doc_id)
SELECT low.doc_id, n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, array_to_string(list_sort(list_distinct(coalesce(base.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(own.labels, []))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM low JOIN total USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query(OP13_SQL)
def op13_template_join(spark, sf_dir):
    found = find_licenses(table(spark, sf_dir, "documents"))
    own = F.transform("base", lambda b: b["label"])
    best = F.array_max(F.transform("found", lambda b: b["share"]))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).alias("last_word"),
        _joined(own).alias("base_labels"),
        _joined(F.concat(own, F.transform("found", lambda b: b["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
