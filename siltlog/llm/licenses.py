"""License detection by ordered signature rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .textscan import ALNUM, text_bytes, words

SLICE = 4 << 20
# Phrases that are always reported, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Families of licenses: label, keywords (each name has one of them; without any, no form with a name is tried), names (as words, lower-case, in regular expressions), versions.
FAMILIES = [
    ("0bsd", "bsd", "0bsd|bsd zero clause|zero clause bsd", ""),
    ("afl", "academic", "academic free", "1.1 1.2 2.0 2.1 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public", "1.0 3.0"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1.0 3.0"),
    ("apache", "apache", "apache(?: software)?", "1.0 1.1 2.0"),
    ("apsl", "apple", "apple public source", "1.0 1.1 1.2 2.0"),
    ("artistic", "artistic", "artistic", "1.0 2.0"),
    ("beerware", "beer", "beer ?ware", ""),
    ("bsd", "bsd|berkeley", "bsd|berkeley software distribution", ""),
    ("bsd-2-clause", "bsd", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", ""),
    ("bsd-3-clause", "bsd", "bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd", ""),
    ("bsd-4-clause", "bsd", "bsd 4 clause|4 clause bsd|original bsd", ""),
    ("bsl", "boost", "boost software", "1.0"),
    ("busl", "business", "business source", "1.1"),
    ("cc-by", "creative|cc by", "creative commons attribution|cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative|cc by", "creative commons attribution non ?commercial|cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative|cc by", "creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative|cc by", "creative commons attribution non ?commercial share ?alike|cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative|cc by", "creative commons attribution no ?deriv(?:ative)?s|cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative|cc by", "creative commons attribution share ?alike|cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", "cc0", "cc0", "1.0"),
    ("cddl", "common", "common development and distribution", "1.0 1.1"),
    ("cecill", "cecill", "cecill", "1.0 1.1 2.0 2.1"),
    ("cpl", "common", "common public", "1.0"),
    ("curl", "curl", "curl", ""),
    ("ecl", "educational", "educational community", "1.0 2.0"),
    ("elastic", "elastic", "elastic", "2.0"),
    ("epl", "eclipse", "eclipse public", "1.0 2.0"),
    ("eupl", "european", "european union public", "1.0 1.1 1.2"),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "1.1 1.2 1.3"),
    ("gpl", "general", "(?:gnu )?general public", "1.0 2.0 3.0"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("ipl", "ibm", "ibm public", "1.0"),
    ("isc", "isc", "isc", ""),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", "2.1 3.0"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("lppl", "latex", "latex project public", "1.0 1.1 1.2 1.3"),
    ("mit", "mit", "mit", ""),
    ("mit", "expat", "expat", ""),
    ("mpl", "mozilla", "mozilla public", "1.0 1.1 2.0"),
    ("ms-pl", "microsoft", "microsoft public", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal", ""),
    ("mulan", "mulan", "mulan (?:permissive software|psl)", "1.0 2.0"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)?(?: open source)?", ""),
    ("odbl", "database", "open data(?: commons)? (?:open )?database|open database", "1.0"),
    ("ofl", "sil", "sil open font", "1.0 1.1"),
    ("openssl", "openssl", "openssl", ""),
    ("osl", "open", "open software", "1.0 1.1 2.0 2.1 3.0"),
    ("php", "php", "php", "3.0 3.01"),
    ("postgresql", "postgresql", "postgresql", ""),
    ("psf", "python", "python(?: software foundation)?", "2.0"),
    ("qpl", "qpl|public", "q public|qpl", "1.0"),
    ("ruby", "ruby", "ruby", ""),
    ("sspl", "server", "server side public", "1.0"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("upl", "universal", "universal permissive", "1.0"),
    ("vim", "vim", "vim", ""),
    ("w3c", "w3c", "w3c(?: software)?", ""),
    ("wtfpl", "wtfpl|fuck", "wtfpl|do what the fuck you want to public", "2"),
    ("x11", "x11", "x11|mit x11", ""),
    ("zlib", "zlib", "zlib(?: libpng)?", ""),
    ("zpl", "zope", "zope public", "1.1 2.0 2.1"),
]
# Forms of a notice: priority (higher wins), confidence, and how it is worded; {n}: a name, {v}: a version or nothing, {i}: the label as words.
FORMS = [
    (5, 0.99, r"spdx licen[cs]e identifier {i}"),
    (4, 0.97, r"(?:licen[cs]ed|released|distributed|available|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})(?: licen[cs]e)?{v}"),
    (4, 0.95, r"(?:{n}) licen[cs]e{v}(?: or)? (?:any )?later(?: version)?"),
    (3, 0.90, r"(?:subject to|governed by|in accordance with|terms of|conditions of|compliance with|copy of|see) the (?:{n}) licen[cs]e{v}"),
    (3, 0.90, r"(?:{n}) licen[cs]e (?:version|v) ?{w}"),
    (2, 0.80, r"(?:{n}) licen[cs]e"),
    (1, 0.70, r"(?:{n}) {w} licen[cs]e"),
]

# Wordings of licenses, their headers and addresses: label, priority, confidence, keyword, and the words as a regular expression.
SIGNATURES = [
    ("0bsd", 7, 0.98, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("afl", 6, 0.95, "academic", "licensed under the academic free license version (?:2 1|3 0)"),
    ("agpl", 6, 0.98, "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", 6, 0.97, "affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl", 6, 0.95, "gnu", "www gnu org licenses agpl(?: 3 0)?"),
    ("apache", 6, 0.99, "apache", "licensed under the apache license version 2 0 the license"),
    ("apache", 6, 0.95, "license", "you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0"),
    ("apache", 6, 0.95, "apache", "www apache org licenses(?: license 2 0)?"),
    ("apache", 5, 0.85, "license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", 6, 0.95, "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("artistic", 6, 0.95, "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic", 5, 0.85, "perl", "under the same terms as perl(?: itself)?"),
    ("beerware", 6, 0.97, "beer", "you can buy me a beer in return"),
    ("bsd", 6, 0.95, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 5, 0.85, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 5, 0.85, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", 6, 0.97, "opensource", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", 6, 0.97, "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd-3-clause", 7, 0.93, "endorse", "nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 7, 0.97, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsl", 6, 0.99, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl", 6, 0.98, "boost", "distributed under the boost software license version 1 0"),
    ("bsl", 6, 0.97, "boost", "www boost org license 1 0"),
    ("busl", 6, 0.95, "business", "use of this software is governed by the business source license"),
    ("cc-by", 6, 0.97, "creativecommons", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-nc", 6, 0.97, "creativecommons", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-nd", 6, 0.97, "creativecommons", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nc-sa", 6, 0.97, "creativecommons", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nd", 6, 0.97, "creativecommons", "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-sa", 6, 0.97, "creativecommons", "creativecommons org licenses by sa [1234] [05]"),
    ("cc0", 6, 0.98, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc0", 6, 0.95, "waived", "has waived all copyright and related or neighboring rights to"),
    ("cddl", 6, 0.98, "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 6, 0.90, "cddl", "opensource org licenses? cddl1?"),
    ("cecill", 6, 0.97, "cecill", "this software is governed by the cecill(?: b| c)? license under french law"),
    ("cpl", 6, 0.95, "common", "the accompanying program is provided under the terms of this common public license"),
    ("curl", 6, 0.85, "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is"),
    ("ecl", 6, 0.95, "educational", "licensed under the educational community license version (?:1|2) 0"),
    ("elastic", 6, 0.95, "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("epl", 6, 0.98, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 6, 0.97, "eclipse", "www eclipse org (?:legal epl(?: v10| 2 0)?|org documents epl(?: v10| 2 0)?)"),
    ("eupl", 6, 0.98, "eupl", "licensed under the eupl"),
    ("eupl", 6, 0.95, "eupl", "joinup ec europa eu(?: software page| collection)? eupl"),
    ("gfdl", 6, 0.98, "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", 6, 0.98, "general", "under the terms of(?: version [23] of)? the gnu general public license as published by the free software foundation"),
    ("gpl", 6, 0.97, "general", "you should have received a copy of the gnu general public license"),
    ("gpl", 6, 0.95, "gnu", "www gnu org licenses gpl(?: 2 0| 3 0)?"),
    ("gpl", 6, 0.95, "general", "gnu general public license version (?:2|3) (?:june 1991|29 june 2007)"),
    ("hpnd", 6, 0.90, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies"),
    ("hpnd", 6, 0.90, "permission", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ipl", 6, 0.95, "ibm", "the accompanying program is provided under the terms of this ibm public license"),
    ("isc", 6, 0.93, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("json", 6, 0.98, "evil", "the software shall be used for good not evil"),
    ("lgpl", 6, 0.98, "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", 6, 0.98, "library", "under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl", 6, 0.97, "lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 6, 0.95, "gnu", "www gnu org licenses lgpl(?: 2 1| 3 0)?"),
    ("lppl", 6, 0.97, "latex", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("mit", 6, 0.98, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 5, 0.90, "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 5, 0.80, "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 6, 0.97, "opensource", "opensource org licenses? mit(?: license)?"),
    ("mpl", 6, 0.99, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", 6, 0.95, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", 6, 0.98, "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl", 6, 0.95, "mozilla", "mozilla org mpl(?: 2 0)?"),
    ("ms-pl", 6, 0.95, "microsoft", "this license governs use of the accompanying software if you use the software you accept this license microsoft public license"),
    ("mulan", 6, 0.97, "mulan", "license coscl org cn mulanpsl2?"),
    ("ncsa", 6, 0.90, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("odbl", 6, 0.97, "opendatacommons", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("ofl", 6, 0.98, "font", "this font software is licensed under the sil open font license"),
    ("ofl", 6, 0.95, "sil", "scripts sil org ofl"),
    ("openssl", 6, 0.97, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("osl", 6, 0.95, "open", "licensed under the open software license version (?:2 1|3 0)"),
    ("php", 6, 0.97, "php", "this source file is subject to version (?:2 02|3 0|3 01) of the php license"),
    ("postgresql", 6, 0.97, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("proprietary", 6, 0.90, "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("psf", 6, 0.97, "psf", "psf is making python available to licensee on an as is basis"),
    ("psf", 6, 0.95, "python", "python software foundation license(?: version 2)?"),
    ("public-domain", 6, 0.90, "domain", "(?:work|file|code|software|program) (?:is|has been) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("ruby", 5, 0.85, "ruby", "under the same terms as ruby(?: itself)?"),
    ("sspl", 6, 0.97, "server", "under the terms of the server side public license version 1"),
    ("unlicense", 6, 0.99, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 6, 0.95, "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 6, 0.95, "unlicense", "unlicense org"),
    ("vim", 6, 0.85, "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", 6, 0.95, "consortium", "www w3 org consortium legal"),
    ("wtfpl", 6, 0.98, "fuck", "you just do what the fuck you want to"),
    ("wtfpl", 6, 0.90, "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("x11", 6, 0.93, "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("zlib", 6, 0.98, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 6, 0.95, "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 5, 0.90, "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zpl", 6, 0.97, "zope", "this software is subject to the provisions of the zope public license"),
]
#: One of these is in every text that a rule or a phrase of BASE matches.
TRIGGERS = (b"licens", b"licenc", b"under", b"permi", b"distribut", b"domain", b"endorse", b"merchantab", b"misrepresent", b"advertising", b"liable", b"waived", b"hosted", b"unmodified", b"unauthorized", b"gnu", b"mozilla", b"apache", b"eclipse", b"creativecommons", b"opendatacommons", b"opensource", b"openssl", b"eupl", b"mpl", b"psf", b"ofl", b"consortium", b"artistic", b"beer", b"evil", b"fuck")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    pattern: re.Pattern


def _words(text: str) -> re.Pattern:
    return re.compile(f"(?<![^ ])(?:{text})(?![^ ])")


@cache
def rules() -> tuple[Rule, ...]:
    """The signatures, and every form for every family, in order of priority; forms with a version only for families that have versions."""
    out = [Rule(label, (keyword,), priority, confidence, _words(text)) for label, priority, confidence, keyword, text in SIGNATURES]
    for label, keywords, names, versions in FAMILIES:
        spoken = "|".join(re.escape(v).replace(r"\.", " ").removesuffix(" 0") + ("(?: 0)?" if v.endswith(".0") else "") for v in sorted(versions.split(), reverse=True))
        for priority, confidence, form in FORMS:
            if "{w}" in form and not versions:
                continue
            optional = f"(?:,? (?:version |v ?)?(?:{spoken}))?" if versions else ""
            text = form.replace("{n}", names).replace("{v}", optional).replace("{w}", f"(?:{spoken})").replace("{i}", label.replace("-", " "))
            gate = ("spdx",) if "{i}" in form else tuple(keywords.split("|"))
            out.append(Rule(label, gate, priority, confidence, _words(text)))
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _gated() -> dict[str, list[int]]:
    """The places of each keyword's rules."""
    out: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            out.setdefault(word, []).append(i)
    return out


def detect(joined: str, present: set[str]) -> list[tuple[int, int, Rule]]:
    """What the rules find in words joined by spaces: (start, end, rule), without what is contained in a detection that goes ahead of it."""
    tried = sorted({i for w in present for i in _gated().get(w, ())})
    found = [(m.start(), m.end(), rules()[i]) for i in tried for m in rules()[i].pattern.finditer(joined)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    starts: list[tuple[int, int]] = []
    kept = []
    for start, end, rule in found:
        if not _contained(starts, start, end):
            kept.append((start, end, rule))
            _insert(starts, start, end)
    return kept


def _contained(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the maximal spans, in order of start and so of end, contains the given one."""
    i = bisect_right(spans, (start, 1 << 62)) - 1
    return i >= 0 and spans[i][1] >= end


def _insert(spans: list[tuple[int, int]], start: int, end: int) -> None:
    i = bisect_left(spans, (start, end))
    j = i
    while j < len(spans) and spans[j][1] <= end:
        j += 1
    spans[i:j] = [(start, end)]


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in {w for r in rules() for w in r.keywords}:
        out.add_word(word, word)
    out.make_automaton()
    return out


#: Bytes of words as they are, and all others as spaces.
_SPACED = bytes(b if ALNUM[b] else 32 for b in range(256))
_BASE_PATTERNS = [(re.compile(f"(?<![^ ]){phrase}(?![^ ])"), label) for phrase, label in BASE.items()]


def _scan(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(part.column(part.schema.names.index("text")))
    found = words(data, offsets, ALNUM)
    rows = []
    for i in range(part.num_rows):
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        if not any(x in text for x in TRIGGERS):
            rows.append((0, None, None, [], [], [], 0.0))
            continue
        joined = b" ".join(text.translate(_SPACED).split()).decode("utf-8", "replace")
        present = {w for _, w in _automaton().iter(joined)}
        base = sorted((m.start(), label) for pattern, label in _BASE_PATTERNS for m in pattern.finditer(joined))
        kept = detect(joined, present)
        ends = np.cumsum([len(w) + 1 for w in joined.split(" ")]) if kept or base else np.zeros(0, np.int64)

        def word(at: int, ends=ends) -> int:
            return int(np.searchsorted(ends, at, "right"))

        spans = [{"start": word(s), "end": word(e - 1) + 1, "label": r.label, "priority": r.priority} for s, e, r in sorted(kept, key=lambda d: d[:2])]
        doubt = float(np.prod([1 - r.confidence for _, _, r in kept] + [0.2] * bool(base)))
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(r.label for _, _, r in kept)})
        rows.append((len(base), word(base[0][0]) if base else None, word(base[-1][0]) if base else None, base_labels, labels, spans, 1 - doubt))
    n_base, first, last, base_labels, labels, spans, score = zip(*rows, strict=True) if rows else ([],) * 7
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])
    return pa.RecordBatch.from_arrays(
        [
            part.column(part.schema.names.index("id")),
            pa.array(np.diff(found.first), pa.int64()),
            *(pa.array(x, pa.int64()) for x in (n_base, first, last)),
            *(pa.array(x, pa.list_(pa.string())) for x in (base_labels, labels)),
            pa.array(spans, pa.list_(span)),
            pa.array(score, pa.float64()),
        ],
        ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"],
    )


def scan_licenses(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per row of docs: the id, n_words, n_base, first_word, last_word, base_labels, labels, detections, score.

    Words are runs of letters and digits, A-Z lower-cased. n_base, first_word,
    last_word and base_labels are of the places where the words of a phrase of BASE stand
    one after another. The rules look for notices in the same words if one of their keywords
    is in these at all; a detection inside of another that has a higher
    priority, or the same and is not shorter, is suppressed. labels has the
    labels of both; detections has the rules' places in words; score is the chance that any is right.

    Null and empty texts have no words and score 0. Equal rows and rows with
    null ids are treated like others; other columns aren't read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield _scan(part)

    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>,"
        " detections array<struct<start:long,end:long,label:string,priority:int>>, score double"
    )
    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")
