"""Licence recognition by sentences: normalised sentences become identifiers, identifier sequences become licences.

A text is cut into sentences, each is normalised, and a table of sentence rules gives it identifiers. Ordered licence rules are then
matched against the sequence of identifiers: an earlier rule takes its sentences before a later one looks, so a full notice
is one licence and not also the short statement that it contains.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardflow.llm.encoding import text_runs

# Wordings of public licences, after normalisation. ``{1}`` is the rule's first group in the identifier.
SENTENCES = [
    ("apache-under-{1}", r"licensed under the apache license,? version (\d\.\d)"),
    ("apache-released-{1}", r"(?:released|distributed|available) under the apache license,? (?:version )?(\d\.\d)"),
    ("apache-not-except", r"you may not use this (?:file|software|work) except in compliance with the license"),
    ("apache-obtain", r"you may obtain a copy of the license at"),
    ("apache-unless", r"unless required by applicable law or agreed to in writing,? software distributed under the license"),
    ("apache-see", r"see the license for the specific language governing permissions"),
    ("mit-under", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit license"),
    ("mit-title", r"^the mit license(?: \(mit\))?$"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit-notice", r"copyright notice and this permission notice shall be included in all copies"),
    ("as-is", r"(?:software|program|work) is provided (?:by the [a-z ]+ )?\"?as is\"?"),
    ("no-liability", r"in no event shall (?:the )?[a-z ,]+ be liable"),
    ("isc-grant", r"permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("bsd-under-{1}", r"(?:released|licensed|distributed|available) under the (?:terms of the )?(?:new |simplified |revised )?bsd ?-?([234])?-?(?:clause)? ?license"),
    ("bsd-permit", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", r"neither the name of .{1,200} may be used to endorse or promote products"),
    ("gpl-under-{1}-later", r"(?:licensed under the (?:terms of the )?)?gnu general public license.{0,80}version (\d)(?:\.0)?,? or (?:\(at your option\) )?any later version"),
    ("gpl-under-{1}", r"licensed under the (?:terms of the )?gnu general public license,? (?:version |v)?(\d)"),
    ("gpl-redistribute-{1}-later", r"redistribute it and/or modify it under the terms of the gnu general public license.{0,120}version (\d).{0,80}later version"),
    ("gpl-redistribute-{1}", r"redistribute it and/or modify it under the terms of the gnu general public license.{0,80}version (\d)"),
    ("lgpl-redistribute-{1}", r"gnu (?:lesser|library) general public license.{0,120}version (\d(?:\.\d)?)"),
    ("lgpl-under-{1}", r"licensed under the (?:terms of the )?gnu (?:lesser|library) general public license,? (?:version |v)?(\d(?:\.\d)?)"),
    ("agpl-{1}", r"gnu affero general public license,?.{0,80}(?:version |v)(\d)"),
    ("gnu-no-warranty", r"distributed in the hope that it will be useful, but without any warranty"),
    ("gnu-received", r"you should have received a copy of the gnu (?:[a-z]+ )?general public license"),
    ("mpl-{1}", r"subject to the terms of the mozilla public license,? (?:v\.? ?|version )(\d\.\d)"),
    ("mpl-under-{1}", r"(?:released|licensed|distributed|available) under the mozilla public license,? (?:v\.? ?|version )?(\d\.\d)"),
    ("cc-{1}", r"(?:licensed|released|distributed|available) under (?:a |the )?cc[ -](by(?:-(?:nc|nd|sa))* ?\d\.\d)"),
    ("cc-{1}", r"creative commons (attribution[a-z -]* \d\.\d)"),
    ("cc0", r"\bcc0\b|creative commons zero|dedicated to the public domain|released into the public domain"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("spdx-{1}", r"spdx-license-identifier: ?((?:\( ?)*{id}(?: ?\))*(?: (?:and|or|with) (?:\( ?)*{id}(?: ?\))*)*)".replace("{id}", r"[a-z0-9][a-z0-9.+:-]*")),
    ("copyright", r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?\d{4}"),
    ("all-rights", r"all rights reserved"),
    ("license-mention", r"\blicensed under\b|\breleased under\b|\blicense agreement\b"),
]
# Identifier sequences and the licence they stand for, in order of precedence. ``?`` marks what may be missing; a
# pattern's group gives the licence its version. ``copyright`` and ``all-rights`` may stand between any two sentences.
LICENSES = [
    ("Apache-{1}", [r"apache-under-(.+)", r"apache-not-except", r"apache-obtain?", r"apache-unless", r"apache-see?"]),
    ("MIT", [r"mit-title?", r"mit-grant", r"mit-notice", r"as-is?", r"no-liability?"]),
    ("ISC", [r"isc-grant", r"as-is?", r"no-liability?"]),
    ("BSD-4-Clause", [r"bsd-permit", r"bsd-source", r"bsd-binary", r"bsd-advert", r"bsd-endorse", r"as-is?", r"no-liability?"]),
    ("BSD-3-Clause", [r"bsd-permit", r"bsd-source", r"bsd-binary", r"bsd-endorse", r"as-is?", r"no-liability?"]),
    ("BSD-2-Clause", [r"bsd-permit", r"bsd-source", r"bsd-binary", r"as-is?", r"no-liability?"]),
    ("GPL-{1}.0-or-later", [r"gpl-redistribute-(.)-later", r"gnu-no-warranty?", r"gnu-received?"]),
    ("GPL-{1}.0-only", [r"gpl-redistribute-(.)", r"gnu-no-warranty?", r"gnu-received?"]),
    ("LGPL-{1}", [r"lgpl-redistribute-(.+)", r"gnu-no-warranty?", r"gnu-received?"]),
    ("AGPL-{1}.0", [r"agpl-(.)", r"gnu-no-warranty?", r"gnu-received?"]),
    ("Unlicense", [r"unlicense"]),
    ("Apache-{1}", [r"apache-(?:under|released)-(.+)"]),
    ("MIT", [r"mit-(?:under|title)"]),
    ("BSD-{1}-Clause", [r"bsd-under-(\d)"]),
    ("BSD", [r"bsd-under-"]),
    ("GPL-{1}.0-or-later", [r"gpl-under-(.)-later"]),
    ("GPL-{1}.0", [r"gpl-under-(.)"]),
    ("LGPL-{1}", [r"lgpl-under-(.+)"]),
    ("MPL-{1}", [r"mpl-(?:under-)?(.+)"]),
    ("CC-{1}", [r"cc-(.+)"]),
    ("CC0-1.0", [r"cc0"]),
    ("{1}", [r"spdx-(.+)"]),
]
# Every sentence rule needs one of these; a normalised sentence without any has no identifier.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "warranty", "liable", "as is", "public domain", "cc0", "creative commons",
           "compliance with the", "copyright notice", "advertising materials", "endorse or promote", "applicable law", "(c)", "©", "all rights reserved",
           "released under", "cc by", "cc-by", "available under", "distributed under")
NEUTRAL = frozenset({"copyright", "all-rights"})

_RULES = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_LICENSES = [
    (name, [(re.compile(p.removesuffix("?")), p.endswith("?")) for p in sequence]) for name, sequence in LICENSES
]
_END = re.compile(
    r"(?<=[.!?;])\s+|\n\s*\n|(?<! OR)(?<! AND)(?<! WITH)\n(?=\s*(?:[A-Z(©]|spdx))(?!\s*(?:OR|AND|WITH) )|(?=SPDX-License)"
)
_MARKS = re.compile(r"^[\s*#/;%\-|>!]+|[\s*#/;%\-|<>!]+$")
_GAPS = re.compile(r"\s+(?:[*#/;%|>]+\s+)*")


def sentences(text: str) -> list[str]:
    """Normalised sentences: compatible characters, lower case, one spelling, no comment marks, single spaces, no final stop.

    A sentence ends at a stop before white space, at an empty line, and at a line break before a capital, unless the line break is
    next to an operator of a licence expression.
    """
    found = []
    for part in _END.split(text):
        s = _GAPS.sub(" ", _MARKS.sub("", unicodedata.normalize("NFKC", part))).lower()
        s = s.replace("licence", "license").replace("“", '"').replace("”", '"').rstrip(" .!?;:")
        if s:
            found.append(s)
    return found


# What may stand between a mention and the licence that it introduces.
_LEAD = re.compile(r"[ ,:(]*(?:(?:the|a|an|terms|conditions|of|both|either|version)[ ,:(]+)*")


@functools.lru_cache(maxsize=50_000)
def identifiers(sentence: str) -> tuple[str, ...]:
    """The identifiers of all rules that match, in order of position; of matches that overlap the longest counts, then the first rule's.

    A mention right before the licence that it introduces is part of it. An SPDX expression gives one identifier for each licence.
    """
    found = [(m.start() - m.end(), k, m.start(), m) for k, (_, pattern) in enumerate(_RULES) for m in pattern.finditer(sentence)]
    chosen: list[tuple[int, int, str, re.Match]] = []
    for _, k, _, m in sorted(found, key=lambda f: f[:3]):
        if all(m.end() <= start or end <= m.start() for start, end, *_ in chosen):
            chosen.append((m.start(), m.end(), _RULES[k][0], m))
    chosen.sort(key=lambda c: c[0])
    names = []
    for i, (_, end, name, m) in enumerate(chosen):
        if name == "license-mention" and i + 1 < len(chosen) and chosen[i + 1][2] not in (name, *NEUTRAL):
            if _LEAD.fullmatch(sentence, end, chosen[i + 1][0]):
                continue
        if name.startswith("spdx"):
            parts = re.split(r" (?:and|or) ", " ".join(re.sub(r"[()]", " ", m[1]).split()))
            names += ["spdx-" + part.replace(" ", "-") for part in parts]
        else:
            names.append(name.replace("{1}", (m[1] or "").strip().replace(" ", "-")) if "{1}" in name else name)
    return tuple(names)


def identifier(sentence: str) -> str | None:
    """The first of a sentence's identifiers."""
    return next(iter(identifiers(sentence)), None)


def _match(sequence: list[tuple[re.Pattern, bool]], ids: list[str | None], at: int) -> tuple[int, str] | None:
    """Where the sequence ends if it starts at ``at``, and its group."""
    group = ""
    for k, (pattern, optional) in enumerate(sequence):
        while k and at < len(ids) and ids[at] in NEUTRAL:
            at += 1
        if at < len(ids) and ids[at] is not None and (m := pattern.fullmatch(ids[at])):
            group = m[1] if pattern.groups else group
            at += 1
        elif not optional:
            return None
    return at, group


def licenses(ids: list[str]) -> tuple[list[str], list[str]]:
    """Licences in the order of their sentences, and the identifiers that no rule took."""
    left: list[str | None] = list(ids)
    found: list[tuple[int, str]] = []
    for name, sequence in _LICENSES:
        at = 0
        while at < len(left):
            end = _match(sequence, left, at) if left[at] is not None else None
            if end is None or end[0] == at:
                at += 1
                continue
            found.append((at, name.replace("{1}", end[1].upper() if name.startswith("CC") else end[1])))
            for i in range(at, end[0]):
                left[i] = None
            at = end[0]
    names = list(dict.fromkeys(n for _, n in sorted(found)))
    return names, [i for i in left if i is not None and i not in NEUTRAL]


def scan(text: str) -> tuple[list[str], list[str], list[str]]:
    """Identifiers of a whole text, its licences, and the identifiers left over."""
    ids = [i for s in sentences(text) if any(a in s for a in ANCHORS) for i in identifiers(s)]
    return ids, *licenses(ids)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, licenses, unmatched, verdict`` for every document, from its whole text.

    ``verdict`` is ``known`` (a licence and nothing left over), ``partial`` (both), ``unknown`` (licence sentences that make no licence) or
    ``none``. A null or empty text has ``none``; repeated rows are scanned one by one; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_runs(batches):
            rows = [scan(t) for t in texts]
            verdicts = [
                ("partial" if rest else "known") if names else ("unknown" if rest else "none") for _, names, rest in rows
            ]
            lists = [pa.array(c, pa.list_(pa.string())) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *lists, pa.array(verdicts)],
                ["doc_id", "sentence_ids", "licenses", "unmatched", "verdict"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(
        run, "doc_id long, sentence_ids array<string>, licenses array<string>, unmatched array<string>, verdict string"
    )
