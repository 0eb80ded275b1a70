"""License scans against a plain count of phrases and known license lines."""

import random
import re

import pytest

from rowloom.llm import licenses as L

SCHEMA = "doc_id long, text string, n_words int, labels string"


def frame(spark, docs):
    """Documents with extra columns whose names the operator gives out."""
    return spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_as_by_plain_count(spark):
    pick = random.Random(3)
    parts = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "mit", "é", "İ", "x-1", "...", "licenses", "\x7f", " "]
    docs = [(i, pick.choice([" ", "-", "\n"]).join(pick.choice(parts) for _ in range(pick.randrange(60)))) for i in range(300)]
    docs += [(i, " ".join(pick.choice(list(L.BASE)) for _ in range(9))) for i in range(20)]
    docs += [(None, "MIT License"), (5, None), (6, ""), (7, " \t"), docs[3], (8, "cc by " * 40_000), (9, "x" * 300_000)]
    got = L.scan_licenses(frame(spark, docs)).collect()
    assert sorted(((r[0], *r[1:6]) for r in got), key=str) == sorted(((i, *plain(t)) for i, t in docs), key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)
    assert L.scan_licenses(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("the GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("a BSD 3-Clause license", "bsd-3-clause"),
        ("mit der Lizenz und by the way", ""),
        ("no license at all", ""),
    ],
)
def test_rules(text, labels):
    assert L.scan_text(text.encode())[5] == labels


def test_rules_are_many_and_ordered():
    ranks = [r.rank for r in L.rules()]
    assert len(ranks) > 300 and ranks == sorted(ranks, reverse=True)
    assert all(label == label.lower() for label, *_ in L.LICENSES)


def test_suppression():
    inside, other = (L.TITLE, 5, 9, "b"), (L.TITLE, 20, 30, "c")
    assert L.resolved([(L.TITLE, 0, 10, "a"), inside, other]) == [(L.TITLE, 0, 10, "a"), other]
    assert L.resolved([(L.TITLE, 0, 10, "a"), (L.TAG, 8, 12, "t")]) == [(L.TAG, 8, 12, "t")]
    assert L.resolved([(L.TITLE, 0, 10, "a"), (L.TITLE, 0, 10, "b")]) == [(L.TITLE, 0, 10, "a")]
    assert L.resolved([]) == []
