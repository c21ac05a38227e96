"""License scans by ordered signature rules.

Texts are reduced to their words, joined by one space, so a rule is a regular expression
over words.  A rule is tried only on texts that hold its keyword.  Of overlapping
detections, those inside a detection of higher priority (or a longer one of the same
priority) are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z, other ASCII but digits and letters to blanks; non-ASCII bytes belong to words.
WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


@dataclass(frozen=True)
class Rule:
    """``pattern`` over single-spaced words; ``keyword`` is in every text it matches."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False  # a phrase of which every place is reported


#: Phrases of which every place is reported.
BASE = [Rule("mit", "mit license", "mit license", 2, 0.9, True), Rule("apache", "apache license", "apache license", 2, 0.9, True), Rule("gpl", "general public license", "general public license", 2, 0.9, True)]

V = r"(?: v(?:ersion)?)?"  # optional word before a version number
#: Names: (label, SPDX identifier as words, keyword, name as a pattern).
NAMES = [
    ("mit", r"mit", "licen", r"(?:mit|expat|mit expat|x11)(?: x11)?(?: style)? licen[sc]e"),
    ("mit-0", r"mit 0", "mit no", r"mit no attribution(?: licen[sc]e)?"),
    ("apache-2.0", r"apache 2 0", "apache", rf"apache(?: software)?(?: licen[sc]e)?{V} 2(?: 0)?"),
    ("apache-1.1", r"apache 1 1", "apache", rf"apache(?: software)?(?: licen[sc]e)?{V} 1 1"),
    ("apache", r"apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("gpl-3.0", r"gpl 3 0(?: only| or later)?", "g", rf"gnu (?:gpl|general public licen[sc]e){V} 3(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl-3.0", r"gplv3\+?", "general public", rf"general public licen[sc]e{V} 3(?: 0)?"),
    ("gpl-2.0", r"gpl 2 0(?: only| or later)?", "g", rf"gnu (?:gpl|general public licen[sc]e){V} 2(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl-2.0", r"gplv2", "general public", rf"general public licen[sc]e{V} 2(?: 0)?"),
    ("gpl", r"gpl", "gpl", r"(?:gnu )?gpl(?: licen[sc]e)?"),
    ("gpl", r"gnu gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl-3.0", r"lgpl 3 0(?: only| or later)?", "l", rf"(?:gnu )?(?:lgpl|lesser general public licen[sc]e){V} 3(?: 0)?"),
    ("lgpl-2.1", r"lgpl 2 1(?: only| or later)?", "l", rf"(?:gnu )?(?:lgpl|lesser general public licen[sc]e){V} 2 1"),
    ("lgpl-2.0", r"lgpl 2 0(?: only| or later)?", "l", rf"(?:gnu )?(?:lgpl|library general public licen[sc]e){V} 2(?: 0)?"),
    ("lgpl", r"lgpl", "l", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)"),
    ("agpl-3.0", r"agpl 3 0(?: only| or later)?", "a", rf"(?:gnu )?(?:agpl|affero general public licen[sc]e){V} 3(?: 0)?"),
    ("agpl", r"agpl", "a", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)"),
    ("gfdl", r"gfdl(?: 1 [123])?", "free documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("bsd-2-clause", r"bsd 2 clause", "bsd", r"(?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", r"bsd 3 clause", "bsd", r"(?:(?:new|modified|revised) bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", r"bsd 4 clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("0bsd", r"0bsd", "bsd", r"(?:zero clause bsd|0 clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?"),
    ("bsd", r"bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("isc", r"isc", "isc licen", r"isc licen[sc]e"),
    ("zlib", r"zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", r"libpng(?: 2 0)?", "libpng licen", r"libpng licen[sc]e"),
    ("boost-1.0", r"bsl 1 0", "boost", rf"boost(?: software)? licen[sc]e(?:{V} 1 0)?"),
    ("mpl-2.0", r"mpl 2 0", "m", rf"(?:mozilla public licen[sc]e|mpl){V} 2(?: 0)?"),
    ("mpl-1.1", r"mpl 1 1", "m", rf"(?:mozilla public licen[sc]e|mpl){V} 1 1"),
    ("mpl", r"mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-2.0", r"epl 2 0", "e", rf"(?:eclipse public licen[sc]e|epl){V} 2(?: 0)?"),
    ("epl-1.0", r"epl 1 0", "e", rf"(?:eclipse public licen[sc]e|epl){V} 1(?: 0)?"),
    ("epl", r"epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", r"edl 1 0", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cddl-1.0", r"cddl 1 0", "d", rf"(?:common development and distribution licen[sc]e|cddl)(?:{V} 1 0)?"),
    ("cddl-1.1", r"cddl 1 1", "d", rf"(?:common development and distribution licen[sc]e|cddl){V} 1 1"),
    ("cpl-1.0", r"cpl 1 0", "common public", r"common public licen[sc]e"),
    ("ipl-1.0", r"ipl 1 0", "ibm public", r"ibm public licen[sc]e"),
    ("eupl-1.2", r"eupl 1 2", "e", rf"(?:european union public licen[sc]e|eupl){V} 1 2"),
    ("eupl-1.1", r"eupl 1 1", "e", rf"(?:european union public licen[sc]e|eupl){V} 1 1"),
    ("eupl", r"eupl", "e", r"(?:european union public licen[sc]e|eupl)"),
    ("artistic-2.0", r"artistic 2 0", "artistic", rf"artistic licen[sc]e{V} 2(?: 0)?"),
    ("artistic-1.0", r"artistic 1 0(?: perl)?", "artistic", rf"(?:perl )?artistic licen[sc]e(?:{V} 1 0)?"),
    ("python-2.0", r"(?:python|psf) 2 0", "python", r"python(?: software foundation)? licen[sc]e"),
    ("php-3.01", r"php 3 01", "php licen", r"php licen[sc]e"),
    ("ruby", r"ruby", "ruby licen", r"ruby licen[sc]e"),
    ("openssl", r"openssl", "openssl", r"openssl(?: ssleay)? licen[sc]e"),
    ("unlicense", r"unlicense", "unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl", "w", r"(?:wtfpl|do what the f\w* you want to public licen[sc]e)"),
    ("cc0-1.0", r"cc0 1 0", "c", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("odbl-1.0", r"odbl 1 0", "o", r"(?:open (?:data commons open )?database licen[sc]e|odbl)"),
    ("odc-by-1.0", r"odc by 1 0", "o", r"(?:open data commons attribution licen[sc]e|odc by)"),
    ("pddl-1.0", r"pddl 1 0", "p", r"(?:public domain dedication and licen[sc]e|pddl)"),
    ("ofl-1.1", r"ofl 1 1", "o", r"(?:sil )?open font licen[sc]e"),
    ("ms-pl", r"ms pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", r"ms rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("nasa-1.3", r"nasa 1 3", "nasa", r"nasa open source agreement"),
    ("osl-3.0", r"osl 3 0", "open software", r"open software licen[sc]e"),
    ("afl-3.0", r"afl 3 0", "academic free", r"academic free licen[sc]e"),
    ("upl-1.0", r"upl 1 0", "universal permissive", r"universal permissive licen[sc]e"),
    ("bsl-1.1", r"busl 1 1", "business source", r"business source licen[sc]e"),
    ("sspl-1.0", r"sspl 1 0", "server side public", r"server side public licen[sc]e"),
    ("elastic-2.0", r"elastic 2 0", "elastic", r"elastic licen[sc]e"),
    ("openrail-m", r"openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?"),
    ("vim", r"vim", "vim licen", r"vim licen[sc]e"),
    ("curl", r"curl", "curl licen", r"curl licen[sc]e"),
    ("ncsa", r"ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("postgresql", r"postgresql", "postgresql licen", r"postgresql licen[sc]e"),
    ("w3c", r"w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e"),
    ("cecill-2.1", r"cecill 2 1", "cecill", r"cecill(?: [bc])?(?: licen[sc]e)?"),
    ("json", r"json", "json licen", r"json licen[sc]e"),
    ("beerware", r"beerware", "beer", r"beer ?ware licen[sc]e"),
    ("ogl-uk-3.0", r"ogl uk 3 0", "open government", r"open government licen[sc]e"),
]
#: Creative Commons: (label part, words of the name, letters).
CREATIVE = [
    ("by-nc-nd", r"attribution non ?commercial no ?deriv(?:atives|s)?(?: works)?", r"by nc nd"), ("by-nc-sa", r"attribution non ?commercial share ?alike", r"by nc sa"), ("by-nc", r"attribution non ?commercial", r"by nc"),
    ("by-nd", r"attribution no ?deriv(?:atives|s)?(?: works)?", r"by nd"), ("by-sa", r"attribution share ?alike", r"by sa"), ("by", r"attribution", r"by"),
]
#: Sentences of license texts: (label, keyword, pattern).
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("mit", "substantial portions", r"(?:the above )?copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "restriction including", r"without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("bsd-3-clause", "neither the name", r"neither the names? of .{1,120}? (?:may|will) be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "may not use this file", r"you may not use this file except in compliance with the license"),
    ("gpl", "terms of the gnu", r"(?:redistribute it and or )?modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl-3.0", "either version 3", r"either version 3 of the licen[sc]e or (?:at your option )?any later version"),
    ("gpl-2.0", "either version 2", r"either version 2 of the licen[sc]e or (?:at your option )?any later version"),
    ("gpl", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses(?: (?:gpl|old licenses))?"),
    ("lgpl", "lesser general public", r"under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl", "affero general public", r"under the terms of the gnu affero general public licen[sc]e"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2.0", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("zlib", "as is without any", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("boost-1.0", "boost org license", r"(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain", r"(?:is|are|placed|released|dedicated|put) (?:hereby )?(?:in|into|to|as) the public domain"),
    ("public-domain", "public domain", r"public domain (?:dedication|mark|work|software)"),
    ("all-rights-reserved", "all rights reserved", r"(?:copyright (?:c )?.{0,80}? )?all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary (?:and|or) confidential|confidential and proprietary)(?: information)?"),
    ("proprietary", "prior written", r"(?:reproduced|distributed|copied|used) .{0,120}?without (?:the )?prior written (?:permission|consent)"),
    ("warranty-disclaimer", "without warrant", r"(?:provided|distributed) (?:on an )?as is(?: basis)? without warrant(?:y|ies)(?: or conditions)? of any kind"),
    ("warranty-disclaimer", "merchantability", r"implied warrant(?:y|ies) of merchantability(?: and| or)? fitness for a particular purpose"),
]
GRANT = r"(?:licen[sc]ed|released|distributed|published|provided|available|offered|shared|redistributed|open ?sourced)(?: to you)? (?:under|with|by|using)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"
NAMED = r"(?:subject to|governed by|covered by|in accordance with|in compliance with|pursuant to|conforms to|see|read|copy of|text of)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; in order within a priority."""
    out = [Rule(label, keyword, pattern, 5, 0.97) for label, keyword, pattern in SENTENCES]
    named = [*NAMES]
    for part, words, letters in CREATIVE:
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{part}-{version.replace(' ', '.')}"
            named.append((label, f"cc {letters} {version}", "c", rf"(?:creative commons|cc) (?:{words}|{letters})(?: licen[sc]e)?{V} {version}(?: international| unported| generic)?(?: licen[sc]e)?"))
            out.append(Rule(label, "creativecommons", rf"creativecommons org licenses {letters} {version}", 5, 0.97))
        named.append((f"cc-{part}", f"cc {letters}", "c", rf"(?:creative commons {words}|cc {letters})(?: licen[sc]e)?"))
    for label, spdx, keyword, name in named:
        keyword = keyword if len(keyword) > 1 else ""
        out.append(Rule(label, "spdx license identifier", rf"spdx license identifier {spdx}", 6, 0.99))
        out.append(Rule(label, keyword, rf"{GRANT} {name}", 4, 0.95))
        out.append(Rule(label, keyword, rf"{NAMED} {name}", 3, 0.85))
        out.append(Rule(label, keyword, name, 1, 0.6))
    return tuple(sorted([*BASE, *out], key=lambda r: -r.priority))


#: One of these is in every text with a detection by a rule without a keyword of its own.
ANY_NAME = [b"licen", b"gpl", b"mpl", b"epl", b"cddl", b"eupl", b"wtfpl", b" cc", b"creative commons", b"odbl", b"odc by", b"pddl"]


def words_of(text: str | None) -> tuple[bytes, int]:
    """(the words between single blanks, their number)."""
    words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b" ", len(words)


class Scanner:
    """Compiled rules by keyword; detections of one text after another."""

    def __init__(self, given: tuple[Rule, ...]) -> None:
        self.rules = given
        by: dict[bytes, list[tuple[int, re.Pattern]]] = defaultdict(list)
        for k, r in enumerate(given):
            by[r.keyword.encode()].append((k, re.compile(b" (?:" + r.pattern.encode() + b")(?= )")))
        self.by_keyword = dict(by)

    def hits(self, words: bytes) -> list[tuple[int, int, int]]:
        """(rule, first word, last word) of every match of every rule whose keyword is there."""
        places: list[tuple[int, int, int]] = []
        for keyword, compiled in self.by_keyword.items():
            if keyword in words if keyword else any(x in words for x in ANY_NAME):
                for k, pattern in compiled:
                    places.extend((k, m.start(), m.end()) for m in pattern.finditer(words))
        if not places:
            return []
        # word numbers by one pass over the text, however many places there are
        number, at, seen = {}, 0, 0
        for edge in sorted({p for _, a, b in places for p in (a, b)}):
            seen += words.count(b" ", at, edge)
            number[edge], at = seen, edge
        return [(k, number[a], number[b] - 1) for k, a, b in places]

    def resolve(self, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Hits that lie in no other hit of higher priority, or longer one of the same."""
        kept: list[tuple[int, int, int]] = []
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for h in hits:
            by[self.rules[h[0]].priority].append(h)
        starts: list[int] = []
        reach: list[int] = []
        for priority in sorted(by, reverse=True):
            level, last = [], -1
            for k, a, b in sorted(by[priority], key=lambda h: (h[1], -h[2], h[0])):
                above = bisect_right(starts, a)
                if b > last and not (above and reach[above - 1] >= b):
                    level.append((k, a, b))
                    last = b
            kept = sorted([*kept, *level], key=lambda h: (h[1], h[2], h[0]))
            starts = [a for _, a, _ in kept]
            reach = []
            for _, _, b in kept:
                reach.append(max(b, reach[-1]) if reach else b)
        return kept


FOUND = "n_words long, base array<struct<label:string,word:long>>, detections array<struct<label:string,first:long,last:long,priority:int,confidence:double,matched:string>>"


def _scan(batches: Iterator[pa.RecordBatch], given: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(given)
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64()), ("matched", pa.string())]))
    for b in batches:
        count, base, found = [], [], []
        for text in b.column(1).to_pylist():
            words, n = words_of(text)
            hits = scanner.hits(words)
            split = words.split() if hits else []
            count.append(n)
            base.append([{"label": given[k].label, "word": a} for k, a, _ in hits if given[k].base])
            found.append(
                [
                    {"label": r.label, "first": a, "last": z, "priority": r.priority, "confidence": r.confidence, "matched": b" ".join(split[a : z + 1]).decode("utf-8", "replace")}
                    for r, a, z in ((given[k], a, z) for k, a, z in scanner.resolve(hits))
                ]
            )
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "n_words", "base", "detections"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, base, detections) of every row; words are numbered from 0.

    ``base``: every place of every base rule, overlaps included.  ``detections``: what is
    left of all rules' matches after suppression, in text order.  Null, empty and wordless
    texts have no words and empty lists; texts are read whole; equal rows give equal rows;
    other columns are not read; an empty table gives no rows.  No shuffle: one pass.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_scan, given=given or rules()), f"doc_id long, {FOUND}")
