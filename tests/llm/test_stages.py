"""The near-copy stage of the pipeline with repeated and missing ids."""

import random

import corpus_pipeline
from rowloom.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each_group_stays_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard.near_duplicates, "__defaults__", ("doc_id", "text", 5, 75, 12))
    pick = random.Random(1)
    words = lambda: [f"w{pick.randrange(10**6)}" for _ in range(60)]
    a, b, c, d, e = (words() for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "x"])
    rows = [
        (5, " ".join(a)), (3, near(a)), (3, " ".join(b)), (None, " ".join(c)), (None, near(c)), (None, " ".join(d)), (9, near(d)),
        (7, " ".join(e)), (7, " ".join(e)), (8, ""), (8, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left.count((3, near(a))) == left.count((3, " ".join(b))) == 1 and (5, " ".join(a)) not in left
    assert sum(r in left for r in ((None, " ".join(c)), (None, near(c)))) == 1
    assert (9, near(d)) in left and (None, " ".join(d)) not in left
    assert left.count((7, " ".join(e))) == 1
    assert [r for r in left if not r[1]] == sorted([(8, ""), (8, None), (None, "")], key=str) and len(left) == 8
