"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from rowloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, path string"


def frame(spark, docs):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "x", 1, "p") for i, t in docs], SCHEMA)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    pick = random.Random(11)
    base = ["".join(pick.choice("abeétnÿÀ×") for _ in range(pick.randrange(6, 11))) for _ in range(25)]
    words = list(base)
    for w in base:
        for _ in range(6):
            i, kind = pick.randrange(len(w)), pick.randrange(3)
            words.append(w[:i] + (pick.choice("abeén") if kind else "") + w[i + (kind != 2) :])
    words += ["eeeeeeee", "eeeeeee", "eeeeeeeee", "tennnnn", "nnnnnet", "TENNNNN", "x" * 4000, "x" * 3999]
    out = []
    for i in range(150):
        out.append((i, " ".join(pick.choice(base) if pick.random() < 0.8 else pick.choice(words) for _ in range(60))))
    return [*out, (None, out[3][1]), (None, None), (900, None), (901, ""), (902, "ab 1 . \n"), out[4], (903, " ".join(words)), (904, "-".join(words)), (905, "Eeeeeeee " * 30_000)]


@pytest.mark.parametrize("subtree, block", [(1 << 20, 100_000), (200, 7), (0, 1000)])
def test_variants_as_by_brute_force(spark, docs, monkeypatch, subtree, block):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (subtree, block))
    got = spelling.group_variants(frame(spark, docs)).collect()
    want = plain(docs)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_search_in_small_blocks(monkeypatch):
    pick = random.Random(2)
    words = sorted({"".join(pick.choice("aeqé") for _ in range(7)) for _ in range(400)})
    shorter = sorted({"".join(pick.choice("aeqé") for _ in range(6)) for _ in range(200)})
    monkeypatch.setattr(spelling, "FRONT", 16)
    monkeypatch.setattr(spelling, "COMPARED", 50)
    for asked in (words, shorter):
        q, w = spelling.near_pairs(spelling.matrix(words), spelling.matrix(asked))
        got = sorted((asked[a], words[b]) for a, b in zip(q.tolist(), w.tolist()))
        assert got == sorted((a, b) for a in asked for b in words if one_edit(a, b))


def test_empty(spark):
    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(1, None), (2, "short wor ds"), (3, "lonelyword")])).count() == 0


def test_chains_end_at_the_root(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", None), ("x", "c"), ("y", None)], "word string, form string")
    assert dict(map(tuple, spelling.roots(forms).collect())) == {"a": "e", "b": "e", "c": "e", "d": "e", "x": "e"}
