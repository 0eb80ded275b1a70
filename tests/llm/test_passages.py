"""Repeated passages, near copies and token ids against brute force."""

import collections
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm import jaccard, repeats, suffixarray, suffixtree

SCHEMA = "doc_id long, text string, anchor string, content int"


def frame(spark, docs):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)


def cut(docs, window, words):
    units = [(t or "").encode().split() if words else (t or "").encode() for _, t in docs]
    seen = collections.Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for (doc_id, _), u in zip(docs, units):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = [x for x, g in zip(u, gone) if not g]
        out.append((doc_id, len(u), sum(gone), spans, b" ".join(kept) if words else bytes(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    pick = random.Random(5)
    passages = [[f"w{pick.randrange(20)}" for _ in range(pick.randrange(5, 30))] for _ in range(5)]
    out = []
    for i in range(40):
        words = []
        while len(words) < pick.randrange(1, 90):
            words += pick.choice(passages) if pick.random() < 0.2 else [f"w{pick.randrange(20)}é"[: pick.randrange(2, 6)]]
        out.append((i, " ".join(words)))
    return [*out, (900, None), (901, ""), (902, " \n\t"), out[3], (903, out[4][1]), (None, out[5][1]), (904, "a " * 300), (905, "ab cd " * 90)]


@pytest.mark.parametrize("members", [4096, 2])
def test_words_removed_as_by_brute_force(spark, docs, members):
    got = suffixtree.dedupe_passages(frame(spark, docs), window=7, gram=3, members=members).collect()
    assert sorted([(*r[:4], bytes(r[4])) for r in got], key=str) == cut(docs, 7, True)


@pytest.mark.parametrize("members", [4096, 2])
def test_bytes_removed_as_by_brute_force(spark, docs, members):
    got = suffixarray.dedupe_bytes(frame(spark, docs), window=20, gram=6, members=members).collect()
    assert sorted([(*r[:4], bytes(r[4])) for r in got], key=str) == cut(docs, 20, False)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffixtree.dedupe_passages(none).count() == 0
    assert suffixarray.dedupe_bytes(none).count() == 0
    assert jaccard.near_duplicates(none, bits=10).count() == 0


def test_suffix_array_and_common_prefixes():
    units = [b"abracadabra", b"abracadabra", b"", b"\xff\x00cadabra"]
    text, first, left = suffixarray.joined(units)
    order = suffixarray.suffix_array(text, 64)
    suffixes = [text[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)
    shared = suffixarray.common_prefixes(text, order, left, 64)
    for r in range(1, len(order)):
        a, b = (text[order[k] : order[k] + left[order[k]]].tolist() for k in (r - 1, r))
        assert shared[r] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def linked(docs, size=5, percent=75):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[j : j + size]) for j in range(len(w) - size + 1)]))
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                top[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for a, (i, _) in enumerate(docs):
        ids[find(a)].append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted([(i, len(s), least[find(a)] if s else i) for a, ((i, _), s) in enumerate(zip(docs, sets))], key=str)


def test_near_copies_as_by_brute_force(spark):
    pick = random.Random(7)
    base = [[f"w{pick.randrange(400)}" for _ in range(pick.randrange(4, 80))] for _ in range(25)]
    passage = [f"p{pick.randrange(400)}" for _ in range(30)]
    docs = []
    for i in range(250):
        words = list(pick.choice(base))
        for _ in range(pick.randrange(0, 5)):
            words[pick.randrange(len(words))] = f"X{pick.randrange(500)}"
        if pick.random() < 0.3:
            at = pick.randrange(len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    docs += [(700, None), (701, ""), (702, " \n"), (703, "one two"), (704, "One TWO"), docs[3], (None, docs[4][1]), (705, "É a b c d"), (706, "é a b c d")]
    got = jaccard.near_duplicates(frame(spark, docs).repartition(6), bits=12).collect()
    assert sorted([tuple(r) for r in got], key=str) == linked(docs)


def test_words_of_patterned_letters_differ(spark):
    from rowloom.llm import quality

    first, second = "a", "b"
    for _ in range(10):  # the two Thue-Morse words of 1 024 letters
        first, second = first + second, second + first
    same = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*same, first])), (2, " ".join([*same, second])), (3, f"{first} p q r s {second} p q r s")], "doc_id long, text string")
    assert {r["n_removed"] for r in suffixtree.dedupe_passages(docs).collect()} == {0}
    alone = docs.where("doc_id < 3").withColumn("text", F.regexp_replace("text", "w[0-9]+ ", ""))
    assert {r["component_id"] for r in jaccard.near_duplicates(alone).collect()} == {1, 2}
    judged = quality.judge(docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in judged.collect()} == {1: 0, 2: 0, 3: 0}


def test_cut_documents_are_handed_back_in_small_batches(monkeypatch):
    """A batch of long texts has neither its words nor what is left of them in memory at once."""
    docs = type("Docs", (), {"schema": T.StructType([T.StructField("id", T.LongType())]), "mapInArrow": lambda self, work, ddl: work})()
    work = repeats.cut_documents(docs, repeats.Unit(True, 2, 1))
    n = 1300
    spans = pa.array([[{"a": 1, "b": 3}] if i % 2 else None for i in range(n)], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"w{i} b c d" for i in range(n)]), spans], ["id", "text", "spans"])
    out = list(work(iter([batch])))
    assert max(b.num_rows for b in out) <= 500
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["id"], r["n_units"], r["n_removed"], r["kept"]) for r in rows] == [
        (i, 4, 2 * (i % 2), f"w{i} d".encode() if i % 2 else f"w{i} b c d".encode()) for i in range(n)
    ]


def test_windows_of_large_batches_are_looked_at_in_small_pieces():
    """What a worker holds does not grow with its batch: not 140 bytes for each byte of two megabytes."""
    docs = type("Docs", (), {"schema": T.StructType([T.StructField("id", T.LongType())]), "mapInArrow": lambda self, work, ddl: work})()
    work = repeats.runs_of(docs, repeats.Unit(False, 200, 32))
    pick = random.Random(3)
    texts = [pick.randbytes(1000).hex() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(texts)], ["id", "th", "text"])
    tracemalloc.start()
    try:
        rows = sum(len(set(b["id"].to_pylist())) for b in work(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000
    assert peak < 100 << 20
