"""License scans: ordered signature rules over normalised words.

A text is lower-cased (A-Z only) and cut into words of digits, letters and
all characters beyond ASCII; rules are regular expressions over its words
joined by one space. They come from a table of license names, written by hand
as expressions, times the ways in which a license is named (tag, grant, title
with version, title, address), plus sentences that stand for a license by
themselves. A rule is tried only where a keyword of its license occurs as a word.

Overlapping detections are resolved by rank: tag > sentence > versioned title
> grant > title > address. A detection falls if one of a higher rank overlaps
it, or if one of its own rank contains it (of equal intervals the first label
stays). Four base phrases are counted at every place, whatever the rules say.

Cases: a null text has no words; texts are scanned whole; rows of one id give
one result each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.llm import textnum as T

#: Phrases that are always labelled.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses: label, keyword that must occur, name as words, versions that stand in the label.
LICENSES = [
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1 0", "3 0", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1 0", "3 0", "3")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", ("2 1", "3 0", "3")),
    ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e", ("2 0", "2")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache(?: software)? licen[sc]e|apache", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", r"(?:the )?mit(?: x11)?", ()),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause) bsd|bsd (?:2|two) clause", ()),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", ()),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", ()),
    ("bsd-0-clause", "bsd", r"(?:0 clause|zero clause) bsd|bsd (?:0|zero) clause", ()),
    ("bsd-0-clause", "0bsd", r"0bsd", ()),
    ("bsd", "bsd", r"bsd", ()),
    ("isc", "isc", r"isc", ()),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("epl", "epl", r"epl", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", ("1 0",)),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("cddl", "common", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cpl", "common", r"common public licen[sc]e", ("1 0",)),
    ("cpal", "common", r"common public attribution licen[sc]e", ("1 0",)),
    ("eupl", "european", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"(?:perl )?artistic", ("1 0", "2 0")),
    ("zlib", "zlib", r"zlib(?: libpng)?", ()),
    ("boost", "boost", r"boost(?: software)?", ("1 0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("1", "2")),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc0", "zero", r"creative commons zero", ("1 0",)),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "commons", r"creative commons by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "commons", r"creative commons by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", r"cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "commons", r"creative commons by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", r"cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "commons", r"creative commons by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", r"cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "commons", r"creative commons by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", r"cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "commons", r"creative commons by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "noderivatives", r"(?:creative commons )?attribution noncommercial noderivatives", ("3 0", "4 0")),
    ("cc-by-nc-sa", "sharealike", r"(?:creative commons )?attribution noncommercial sharealike", ("3 0", "4 0")),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution noncommercial", ("3 0", "4 0")),
    ("cc-by-nd", "noderivatives", r"(?:creative commons )?attribution noderivatives", ("3 0", "4 0")),
    ("cc-by-sa", "sharealike", r"(?:creative commons )?attribution sharealike", ("3 0", "4 0")),
    ("cc-by", "commons", r"creative commons attribution", ("2 0", "3 0", "4 0")),
    ("odbl", "odbl", r"odbl", ("1 0",)),
    ("odbl", "database", r"open (?:data commons open )?database licen[sc]e", ("1 0",)),
    ("odc-by", "commons", r"open data commons attribution", ("1 0",)),
    ("pddl", "pddl", r"pddl", ("1 0",)),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("psf", "python", r"python software foundation", ("2",)),
    ("python", "python", r"python", ("2 0",)),
    ("ruby", "ruby", r"ruby", ()),
    ("php", "php", r"php", ("3 0", "3 01")),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("openssl", "openssl", r"openssl", ()),
    ("curl", "curl", r"curl", ()),
    ("x11", "x11", r"x11", ()),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ()),
    ("ms-pl", "microsoft", r"microsoft public", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal", ()),
    ("afl", "academic", r"academic free", ("1 1", "2 1", "3 0")),
    ("osl", "open", r"open software", ("1 0", "2 1", "3 0")),
    ("upl", "universal", r"universal permissive", ("1 0",)),
    ("bsl", "business", r"business source", ("1 1",)),
    ("sspl", "server", r"server side public", ("1",)),
    ("elastic", "elastic", r"elastic", ("2 0",)),
    ("json", "json", r"json", ()),
    ("qpl", "qpl", r"qpl", ("1 0",)),
    ("qpl", "q", r"q public", ("1 0",)),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?", ()),
]

#: Sentences that stand for a license: label, keyword, words.
SENTENCES = [
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("boost", "boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("wtfpl", "fuck", r"do what the fuck you want to"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
]

#: Addresses: label, keyword, words of the address.
ADDRESSES = [
    ("gpl", "gnu", r"(?:www )?gnu org licenses(?: old licenses)? gpl"),
    ("lgpl", "gnu", r"(?:www )?gnu org licenses(?: old licenses)? lgpl"),
    ("agpl", "gnu", r"(?:www )?gnu org licenses agpl"),
    ("apache", "apache", r"(?:www )?apache org licenses"),
    ("mpl", "mozilla", r"(?:www )?mozilla org mpl"),
    ("mit", "opensource", r"opensource org licenses mit"),
    ("bsd", "opensource", r"opensource org licenses bsd"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by"),
]

#: Ranks and the confidence of a detection of that rank.
ADDRESS, TITLE, GRANT, VERSIONED, SENTENCE, TAG = range(6)
CONFIDENCE = (0.8, 0.7, 0.85, 0.95, 0.9, 1.0)
_GRANTED = r"(?:licen[sc]ed|released|distributed|published|available|provided|redistributed) under (?:the |a )?(?:terms of (?:the )?)?"
_TITLE_END = r" licen[sc]e"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    rank: int
    pattern: re.Pattern


def _rule(label: str, keyword: str, rank: int, words: str) -> Rule:
    return Rule(label, f" {keyword} ".encode(), rank, re.compile(f" (?:{words})(?= )".encode()))


@cache
def rules() -> tuple[Rule, ...]:
    """All signature rules, most important first."""
    out = []
    for label, keyword, name, versions in LICENSES:
        titled = name if "licen[sc]e" in name or "pl" in keyword else f"(?:{name}){_TITLE_END}"
        out.append(_rule(label, "spdx", TAG, rf"spdx license identifier (?:{name})(?: (?:only|or later))?"))
        out.append(_rule(label, keyword, GRANT, rf"{_GRANTED}(?:{name})(?: licen[sc]e)?"))
        out.append(_rule(label, keyword, TITLE, titled))
        for v in versions:
            full = f"{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            out.append(_rule(full, "spdx", TAG, rf"spdx license identifier (?:{name}) {v}(?: (?:only|or later))?"))
            out.append(_rule(full, keyword, VERSIONED, rf"(?:{_GRANTED})?(?:{name})(?: licen[sc]e)?(?: (?:version|v))? v?{v}(?! [0-9] )(?: (?:international|unported))?"))
    out += [_rule(label, keyword, SENTENCE, words) for label, keyword, words in SENTENCES]
    out += [_rule(label, keyword, ADDRESS, words) for label, keyword, words in ADDRESSES]
    return tuple(sorted(out, key=lambda r: -r.rank))


@cache
def _gates() -> tuple[tuple[bytes, tuple[Rule, ...]], ...]:
    held: dict[bytes, list[Rule]] = {}
    for r in rules():
        held.setdefault(r.keyword, []).append(r)
    return tuple((k, tuple(v)) for k, v in held.items())


#: Lower case for A-Z and a space for every byte that ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE_PLACES = [(f" {phrase} ".encode(), re.compile(f" {phrase}(?= )".encode()), label) for phrase, label in BASE.items()]


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Of detections (rank, start, end, label) those that no other one suppresses."""
    kept: list[tuple[int, int, int, str]] = []
    starts, reach = [], []  # of the kept ones of higher ranks: starts, and the furthest end so far
    for rank in sorted({f[0] for f in found}, reverse=True):
        furthest = -1
        for d in sorted({f for f in found if f[0] == rank}, key=lambda f: (f[1], -f[2], f[3])):
            _, start, end, _ = d
            above = bisect_left(starts, end)
            if end > furthest and not (above and reach[above - 1] > start):
                kept.append(d)
                furthest = end
        kept.sort(key=lambda f: f[1])
        starts = [f[1] for f in kept]
        reach = np.maximum.accumulate([f[2] for f in kept]).tolist()
    return kept


def _place(text: bytes, at: int) -> int:
    """Number of the word that begins after the space at ``at``."""
    return text.count(b" ", 0, at)


def scan_text(data: bytes) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score, detections) of one text."""
    words = data.translate(_WORDS).split()
    text = b" %s " % b" ".join(words)
    places, base = [], set()
    for words_, pattern, label in _BASE_PLACES:
        if words_ in text:
            places += [m.start() for m in pattern.finditer(text)]
            base.add(label)
    found = [(r.rank, m.start(), m.end(), r.label) for keyword, listed in _gates() if keyword in text for r in listed for m in r.pattern.finditer(text)]
    kept = resolved(found)
    spans = [(d[3], _place(text, d[1]), len(text[d[1] : d[2]].split()), CONFIDENCE[d[0]]) for d in kept]
    labels = base | {d[3] for d in kept}
    score = max([CONFIDENCE[d[0]] for d in kept] + [CONFIDENCE[TITLE]] * bool(base), default=0.0)
    ends = (_place(text, min(places)), _place(text, max(places))) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("confidence", pa.float64())]))
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", _SPANS),
]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row.

    ``detections`` lists what the rules found and kept: label, first word,
    number of words, confidence. No shuffle: texts are scanned where they lie.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.raw(batch["t"])
            whole = data.tobytes()
            bounds = offsets.tolist()
            rows = [scan_text(whole[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            detections = [[dict(zip(("label", "word", "words", "confidence"), s)) for s in r[-1]] for r in rows]
            columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS[:-1])] + [pa.array(detections, _SPANS)]
            yield pa.RecordBatch.from_arrays([batch["i"], *columns], ["i", *(n for n, _ in _FIELDS)])

    schema = (
        f"i {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "detections array<struct<label:string,word:bigint,words:bigint,confidence:double>>"
    )
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(work, schema)
    return rows.withColumnRenamed("i", id_col)
