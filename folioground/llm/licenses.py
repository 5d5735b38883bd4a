"""License scan by diagonal voting.

Every place of a text where ``k`` consecutive words also stand in a license template votes for the diagonal
(place in the text - place in the template). Votes are joined to the template places in Spark, counted by text,
template and diagonal, neighbouring diagonals are merged (words put in or left out move a match to the next
diagonal), and each merged span is verified word by word against its template: the words that an alignment of the
span finds in order, as a share of the template or, if it is longer, of the part of the text that they extend over. That part
must also have the words that tell licenses apart (names, version numbers, SA, ND, NC, Lesser, Affero) just as the template has
them, so a notice of another license or version gets no label of its neighbours, however many words it shares.

The texts are read once. Rolling hashes that are no template hash cannot join and are left out where they are made;
the template table has one row for each template word and is refused above ``TEMPLATE_WORDS``. A text with votes
goes along into the written table, whole, for the verification; all others leave only their counts.

Base phrases are found on the same words, exactly, and are reported apart (``n_base``, ``base_labels``). They count as they
stand, without verification: "CC BY-NC-SA" holds the phrase "cc by nc" and gets its label besides its own.

Defined cases: a null text is empty, has no words and null places; repeated rows are scanned each by itself; a phrase
that overlaps itself counts at each place; equal labels count once, sorted; an empty table gives no rows; columns other
than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioground.llm.base import ALNUM, Words, chunks, staged, texts_of, window_hashes

#: Phrase -> label. Fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: The six Creative Commons licenses by label: short form and name.
CREATIVE_COMMONS = {
    "cc-by": ("BY", "Attribution"),
    "cc-by-sa": ("BY-SA", "Attribution-ShareAlike"),
    "cc-by-nd": ("BY-ND", "Attribution-NoDerivatives"),
    "cc-by-nc": ("BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-sa": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
_FREE = ("This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
         "either version {version} of the License, or (at your option) any later version.")
_GNU = [
    "This work is licensed under the GNU {name}, version {version}.",
    "Licensed under the GNU {name}, version {version}.",
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} version {version}",
    _FREE,
    _FREE.replace("either ", "").replace(", or (at your option) any later version", ""),
]


def _gnu(name: str, version: str, work: str = "program") -> list[str]:
    return [t.format(name=name, version=version, work=work) for t in _GNU]


#: Notices by which works are put under a license, and openings of license bodies, by label. The words count, not case or marks.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "gpl-2": [*_gnu("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-3": [*_gnu("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl-2.1": [*_gnu("Lesser General Public License", "2.1", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-3": [*_gnu("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl-3": [*_gnu("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "Mozilla Public License Version 2.0 1. Definitions",
    ],
    "epl-2": ["Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsl-1": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
} | {
    label: [t for v in ("4.0", "3.0", "2.5", "2.0") for t in (f"Licensed under CC {short} {v}.", f"This work is licensed under a Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License.")]
    for label, (short, name) in CREATIVE_COMMONS.items()
}
#: Words that tell licenses apart, besides numbers of one or two digits: an aligned text has those of its template, in order, and no others.
TELLING = frozenset("""mit apache bsd isc mozilla eclipse boost unicode font gnu lesser affero general public documentation domain organization associated
    cc creative commons nc nd sa sharealike alike noncommercial commercial noderivatives noderivs derivatives derivative derivs""".split())
TEMPLATE_WORDS = 100_000
#: Words of a vote, diagonals that are merged, and the share of a template's words that a span must have in order.
VOTE, NEIGHBOURS, SHARE = 3, 3, 0.8


def words_of(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), ALNUM)
    return [bytes(raw[a:b]).decode().translate(_LOWER) for a, b in zip(w.start, w.end)]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM).hash


def _numbered(templates: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    pairs = [(label, text) for label, texts in templates.items() for text in texts]
    return [(n, label, text) for n, (label, text) in enumerate(pairs)]


def _scan(docs: DataFrame, templates: list[tuple[int, str, str]], phrases: dict[str, str], key: str, text: str) -> DataFrame:
    """One row for each text: counts, base places and labels, votes as (hash, place), and the text if it has votes."""
    wanted = np.unique(np.concatenate([window_hashes(_hashes(t), VOTE) for _, _, t in templates] + [np.zeros(0, np.uint64)]))
    base = [(window_hashes(h, len(h))[0], len(h), words_of(p), label) for p, label in phrases.items() if len(h := _hashes(p))]
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            rows = []
            for low, high in chunks(offsets):
                raw, at = data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
                w = Words(raw, at, ALNUM)
                first = w.first

                def places(windows, found, k):
                    """Windows found, by text; those that cross into the next text are left out."""
                    i = np.flatnonzero(found)
                    row = np.searchsorted(first, i, "right") - 1
                    inside = i + k <= first[row + 1]
                    return i[inside], row[inside]

                windows = window_hashes(w.hash, VOTE)
                hit = np.searchsorted(wanted, windows)
                hit[hit == len(wanted)] = 0
                vote, vote_row = places(windows, wanted[hit] == windows if len(wanted) else np.zeros(len(windows), bool), VOTE)
                starts: list[tuple[int, int, str]] = []
                for h, k, phrase, label in base:
                    windows_k = window_hashes(w.hash, k)
                    for i, row in zip(*places(windows_k, windows_k == h, k)):
                        said = [bytes(raw[a:b]).decode().translate(_LOWER) for a, b in zip(w.start[i: i + k], w.end[i: i + k])]
                        if said == phrase:
                            starts.append((int(row), int(i - first[row]), label))
                by_row: dict[int, list[tuple[int, str]]] = {}
                for row, i, label in starts:
                    by_row.setdefault(row, []).append((i, label))
                cut = np.searchsorted(vote_row, np.arange(high - low + 1))
                for r in range(high - low):
                    own = by_row.get(r, [])
                    v = vote[cut[r]: cut[r + 1]]
                    rows.append((int(first[r + 1] - first[r]), len(own), min((i for i, _ in own), default=None), max((i for i, _ in own), default=None), sorted({x for _, x in own}),
                                 windows[v].view(np.int64).tolist(), (v - first[r]).tolist(), bytes(raw[at[r]: at[r + 1]]).decode() if len(v) else None))
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "n_words", "n_base", "first_word", "last_word", "base", "hashes", "places", "text"])

    scanned = docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, hashes array<bigint>, places array<bigint>, text string")
    return staged(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")


def _places_of(docs: DataFrame, templates: list[tuple[int, str, str]]) -> DataFrame:
    """(hash, template, at) of every vote that templates can get."""
    rows = [(int(h), n, at) for n, _, t in templates for at, h in enumerate(window_hashes(_hashes(t), VOTE).view(np.int64))]
    if len(rows) > TEMPLATE_WORDS:
        raise ValueError(f"templates have {len(rows)} places; {TEMPLATE_WORDS} may be broadcast")
    return docs.sparkSession.createDataFrame(rows, "hash bigint, template int, at int")


def _spans(scanned: DataFrame, places: DataFrame) -> DataFrame:
    """(row, template, low, high): spans of words to verify, one for each run of neighbouring diagonals."""
    votes = scanned.where(F.size("hashes") > 0).select("row", F.explode(F.arrays_zip("hashes", "places")).alias("v")).select("row", F.col("v.hashes").alias("hash"), F.col("v.places").alias("place"))
    met = votes.join(F.broadcast(places), "hash")  # at most TEMPLATE_WORDS rows
    diagonals = met.groupBy("row", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("votes"))
    # Diagonals of one text and template, in order; a gap above NEIGHBOURS starts another span. A text has at most as many as words.
    w = W.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOURS, F.lit(False)).cast("int")
    runs = diagonals.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(w))
    return runs.groupBy("row", "template", "run").agg(F.min("low").alias("low"), (F.max("high") + VOTE).alias("high"), F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes"))


def _common(span: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each beginning of ``span`` with ``template``, a row of the table at a time."""
    row, out = np.zeros(len(template) + 1, np.int64), np.zeros(len(span) + 1, np.int64)
    for i, x in enumerate(span):
        row[1:] = np.maximum(row[1:], np.maximum.accumulate(np.where(template == x, row[:-1] + 1, row[1:])))
        out[i + 1] = row[-1]
    return out


def _aligned(span: list[str], template: list[str]) -> tuple[int, int, int]:
    """(words that stand in both in order, first and end of the part of ``span`` that has them)."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
    a, b = np.array([codes.get(w, -1) for w in span], np.int64), np.array([codes[w] for w in template])
    upto = _common(a, b)
    end = int(np.argmax(upto))
    return int(upto[-1]), end - int(np.argmax(_common(a[:end][::-1], b[::-1]))), end


def _telling(words: list[str]) -> list[str]:
    return [w for w, after in zip(words, [*words[1:], ""]) if w in TELLING or w.isdigit() and len(w) <= 2 or w == "library" and after == "general"]


def _verified(scanned: DataFrame, spans: DataFrame, templates: list[tuple[int, str, str]]) -> DataFrame:
    """(row, label, low, high, share) of the spans that hold enough of their template."""
    said = {n: (label, words_of(t), _telling(words_of(t))) for n, label, t in templates}

    def continues(raw, w, end):
        """Whether the number before place ``end`` goes on, as 3 does in 3.1; 3.0 is 3."""
        if end == len(w.start) or not bytes(raw[w.start[end - 1]: w.end[end - 1]]).isdigit() or bytes(raw[w.end[end - 1]: w.start[end]]) != b".":
            return False
        after = bytes(raw[w.start[end]: w.end[end]])
        return after.isdigit() and after.strip(b"0") != b""

    def run(batches):
        for batch in batches:
            out = []
            for row, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(text.encode(), np.uint8)
                w = Words(raw, np.array([0, len(raw)]), ALNUM)
                tried = []
                for s in found:
                    label, template, telling = said[s["template"]]
                    low = max(0, min(s["low"], s["diagonal"]))
                    high = min(len(w.start), max(s["high"], s["last"] + len(template) + NEIGHBOURS))
                    words = [bytes(raw[a:b]).decode().translate(_LOWER) for a, b in zip(w.start[low:high], w.end[low:high])]
                    same, first, end = _aligned(words, template)
                    share = same / max(len(template), end - first)
                    if share >= SHARE and _telling(words[first:end]) == telling and not continues(raw, w, low + end):
                        tried.append((-same, -share, low + first, low + end, label))
                # Where spans of several labels overlap, the one with most words in order stands.
                taken: list[tuple[int, int, str]] = []
                for _, share, low, high, label in sorted(tried):
                    if all(high <= a or low >= b or other == label for a, b, other in taken):
                        taken.append((low, high, label))
                        out.append((row, label, low, high, -share))
            columns = list(zip(*out)) if out else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["row", "label", "low", "high", "share"])

    by_text = spans.groupBy("row").agg(F.collect_list(F.struct("template", "low", "high", "diagonal", "last")).alias("found"))
    return scanned.select("row", "text").join(by_text, "row").select("row", "text", "found").mapInArrow(run, "row bigint, label string, low bigint, high bigint, share double")


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): one row for each text, and the verified spans (key, label, low, high, share), words from 0.

    ``score`` of a text is the highest verified share, 1 where a base phrase stands, else 0.
    """
    numbered = _numbered(templates)
    scanned = _scan(docs, numbered, phrases, key, text)
    found = staged(_verified(scanned, _spans(scanned, _places_of(docs, numbered)), numbered), "verified_spans")
    by_text = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    facts = scanned.drop("hashes", "places", "text").join(by_text, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    texts = facts.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                         F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
    spans = found.join(scanned.select("row", F.col("key").alias(key)), "row").select(key, "label", "low", "high", "share")
    return texts, spans
