"""License scans by a positional index of rare words.

Words are runs of digits, letters and all that is not ASCII, with A-Z lower-cased. A template is a licence's notice or a stretch of its text; it is found
where at least ``share`` of its words stand at their relative positions (a shift of up to ``SLACK`` words between them is an edit), and
its mandatory key phrases stand in that passage word by word. A base phrase is a template of which nothing may be missing.

1. Document frequencies of all words of the templates are counted over all documents in Spark.
2. Of a template of n words, a passage may lack floor((1 - share) * n). So it holds one at least of the template's words of highest IDF, if one more than
   that many are taken. Only these go into the index: hash of the word, template, position. Nothing above ``share`` is lost.
3. Each text looks up its words in the index; what stands there less the position in the template is where the template would begin. Beginnings
   of one template that are close together are one passage, whose words are compared with the whole template.
4. Passages with enough words are kept if each key phrase is in them.

The index has as many entries as the templates have rare words, so what tasks receive does not grow with the corpus. Documents
are read twice and never shuffled.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows and rows with a null id are documents of their own;
words of equal IDF are taken by their order; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts
from .decontam import tokens

SLACK = 4
_ROWS = 4096  # beginnings whose words are compared at once

# Base phrases and their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Label, template (wording of the public licence or of its usual notice) and mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "prior written permission"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
]


@dataclass
class Template:
    label: str
    words: np.ndarray
    keys: list[np.ndarray]
    base: bool
    needed: int  # words that a passage has at least


@dataclass
class Index:
    """Sorted hashes of rare words, and the templates and positions of each: postings[first[i]:first[i + 1]]."""

    templates: list[Template]
    hashes: np.ndarray
    first: np.ndarray
    template: np.ndarray
    position: np.ndarray


def word_list(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0]


def templates(share: float, listed: list | None = None, base: list | None = None) -> list[Template]:
    """The base phrases, then the other templates."""
    out = []
    for text, label in BASE if base is None else base:
        w = word_list(text)
        out.append(Template(label, w, [w], True, len(w)))
    for label, text, keys in TEMPLATES if listed is None else listed:
        w = word_list(text)
        out.append(Template(label, w, [word_list(k) for k in keys], False, int(np.ceil(share * len(w) - 1e-9))))
    return out


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each word of the (sorted) vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in chunks(at):
                hashes, row = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                k = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[k] == hashes)
                total += np.bincount(np.unique(row[hit] * len(vocabulary) + k[hit]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(count, "word INT, n BIGINT").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def build(made: list[Template], vocabulary: np.ndarray, frequency: np.ndarray) -> Index:
    """The rare words of each template: as many occurrences as a passage may lack, and one more."""
    hashes, template, position = [], [], []
    for t, x in enumerate(made):
        of = frequency[np.searchsorted(vocabulary, x.words)]
        rare = np.lexsort([np.arange(len(x.words)), x.words, of])[: len(x.words) - x.needed + 1]
        hashes.append(x.words[rare])
        template.append(np.full(len(rare), t))
        position.append(rare)
    h, t, p = np.concatenate(hashes), np.concatenate(template), np.concatenate(position)
    by = np.lexsort([p, t, h])
    keys, first = np.unique(h[by], return_index=True)
    return Index(made, keys, np.append(first, len(by)), t[by], p[by])


def index(docs: DataFrame, share: float = 0.6, listed: list | None = None, base: list | None = None) -> Index:
    """The templates with their words of highest IDF in docs. IDF falls as the document frequency grows, which alone sets the order."""
    made = templates(share, listed, base)
    vocabulary = np.unique(np.concatenate([t.words for t in made]))
    return build(made, vocabulary, document_frequencies(docs, vocabulary))


def _holds(passage: np.ndarray, phrase: np.ndarray) -> bool:
    at = np.flatnonzero(passage[: len(passage) - len(phrase) + 1] == phrase[0]) if len(passage) >= len(phrase) else ()
    return any(np.array_equal(passage[i : i + len(phrase)], phrase) for i in at)


def matches(found: Index, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Row, template, first word (in hashes) and share of each passage that is verified."""
    k = np.searchsorted(found.hashes, hashes)
    k[k == len(found.hashes)] = 0
    hit = np.flatnonzero(found.hashes[k] == hashes)
    if not len(hit):
        return
    count = found.first[k[hit] + 1] - found.first[k[hit]]
    of = np.repeat(found.first[k[hit]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place = np.repeat(hit, count)
    begin, kind, line = place - found.position[of], found.template[of], row[place]
    for t in np.unique(kind):
        x = found.templates[t]
        n, mine = len(x.words), kind == t
        # beginnings by row and place; one may lie before its row, if an edit has taken words away
        starts = np.unique(np.stack([line[mine], begin[mine]]), axis=1)
        gap = 0 if x.base else SLACK
        cut = np.flatnonzero((np.diff(starts[0]) != 0) | (np.diff(starts[1]) > gap)) + 1
        edges = np.concatenate([[0], cut])
        same = np.zeros((len(edges), n), bool)
        group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, starts.shape[1])))
        for lo in range(0, starts.shape[1], _ROWS):
            part = starts[:, lo : lo + _ROWS]
            at = part[1][:, None] + np.arange(n)
            inside = (at >= 0) & (at < len(hashes))
            at = np.where(inside, at, 0)
            equal = inside & (row[at] == part[0][:, None]) & (hashes[at] == x.words)
            np.logical_or.at(same, group[lo : lo + _ROWS], equal)
        enough = np.flatnonzero(same.sum(1) >= x.needed)
        for g in enough:
            r = int(starts[0][edges[g]])
            last = edges[g + 1] if g + 1 < len(edges) else starts.shape[1]
            a, z = np.searchsorted(row, [r, r + 1])
            lo, hi = max(int(a), int(starts[1][edges[g]])), min(int(z), int(starts[1][last - 1]) + n)
            if all(_holds(hashes[lo:hi], key) for key in x.keys):
                yield r, int(t), lo, float(same[g].mean())


def scan(docs: DataFrame, found: Index) -> DataFrame:
    """For every row of docs: doc_id, n_words, places (label and first word of each base phrase), licences (label, first word and share of
    each verified passage), labels (of both, distinct, in order) and score, the largest share."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])
    passage = pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            raw, at = texts(batch.column(1))
            for lo, hi in chunks(at):
                hashes, row = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                places, licences = [[] for _ in range(lo, hi)], [[] for _ in range(lo, hi)]
                for r, t, start, share in matches(x, hashes, row):
                    one = {"label": x.templates[t].label, "start": start - int(first[r])}
                    (places[r].append(one) if x.templates[t].base else licences[r].append(one | {"share": share}))
                both = [a + b for a, b in zip(places, licences, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        pa.array([sorted(p, key=lambda m: (m["start"], m["label"])) for p in places], pa.list_(place)),
                        pa.array([sorted(p, key=lambda m: (m["start"], m["label"], m["share"])) for p in licences], pa.list_(passage)),
                        pa.array([sorted({m["label"] for m in b}) for b in both], pa.list_(pa.string())),
                        pa.array([max((m.get("share", 1.0) for m in b), default=0.0) for b in both], pa.float64()),
                    ],
                    ["doc_id", "n_words", "places", "licences", "labels", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words BIGINT, places ARRAY<STRUCT<label: STRING, start: BIGINT>>, licences ARRAY<STRUCT<label: STRING, start: BIGINT, share: DOUBLE>>, labels ARRAY<STRING>, score DOUBLE"
    return docs.select("doc_id", "text").mapInArrow(apply, schema)
