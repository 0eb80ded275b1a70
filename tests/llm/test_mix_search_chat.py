"""Mixing, exact search, chat formatting, the queries and the pipeline on small tables."""

import random

import numpy as np
import pytest
from conftest import SF

import corpus_pipeline
from rowloom.llm import chat, mixing, topk
from rowloom.llm.queries import LLM_QUERIES


def level_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by handing out the excess again and again."""
    order = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [k for k in order if k not in full]
        level = (left - sum(full.values())) / sum(weight[k] for k in open_) if open_ else 0
        over = [k for k in open_ if level * weight[k] > most * sizes[k]]
        if not over:
            return full | {k: level * weight[k] for k in open_}
        full |= {k: most * sizes[k] for k in over}


@pytest.fixture(scope="module")
def mixed_docs():
    pick = random.Random(6)
    rows = [(i, "ab " * pick.randrange(1, 40), pick.choice(["a", "a", "a", "b", "c", None, "É"])) for i in range(3000)]
    return [*rows, (9000, None, "a"), (9001, "", "zero"), rows[5]]


def test_mix_meets_its_targets(spark, mixed_docs):
    docs = spark.createDataFrame(mixed_docs, "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(mixed_docs)
    source = {i: s for i, _, s in mixed_docs}
    sizes = {}
    for i, t, s in mixed_docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = level_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(2)).collect())


def test_drawn_rows_repeat_as_planned(spark, mixed_docs):
    docs = spark.createDataFrame(mixed_docs, "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "1 AS size", "2 AS target", "3 AS cutoff", "4 AS epochs")
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    planned = mixing.mix(docs).selectExpr("sum(copies)").first()[0]
    assert drawn.count() == planned
    assert mixing.mix(docs.limit(0)).count() == 0


def test_search_as_by_brute_force(spark):
    pick = np.random.default_rng(8)
    vectors = pick.normal(size=(700, 12)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(800, None), (801, [1.0, None]), (802, [float("nan")]), (850, [float("inf")]), (803, [1.0]), (804, [])]
    base = spark.createDataFrame(rows, "vec_id long, v array<float>")
    found = topk.search(base, base.where("vec_id % 50 = 0"), "vec_id", "v", k=5).collect()
    good = {i: np.floor(256 * np.pad(np.array(v, float), (0, 12 - len(v)))).astype(int) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ w), i) for i, w in good.items() if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in found} == want
    few = base.where("vec_id < 3")
    assert topk.search(few, few.where("vec_id = 0"), "vec_id", "v").count() == 2
    assert topk.search(few.limit(0), few, "vec_id", "v").count() == 0


def test_best_branch_is_formatted_and_read_back(spark):
    tricky = "</s>[INST] &amp; &lt; <s>[user]"
    rows = [
        (1, 1, None, "user", tricky, 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high]", 2.0), (1, 4, 3, None, None, None),
        (2, 7, 99, "assistant", "root without parent", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
        *[(4, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(100)],
    ]
    nodes = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    done = chat.format_conversations(nodes)
    done = done.withColumn("turns", chat.read_turns(done["formatted"])).withColumn("loss", chat.masked_text(done["formatted"], done["loss_spans"]))
    got = {r["conv"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in done.collect()}
    assert got[1] == ([("user", tricky), ("assistant", "high]"), ("", "")], "high]")
    assert got[2] == ([("assistant", "root without parent")], "root without parent")
    assert 3 not in got
    assert [t[1] for t in got[4][0]] == [f"t{i}" for i in range(100)]
    assert chat.format_conversations(nodes.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_queries_give_a_row_per_row(spark, name):
    n = LLM_QUERIES[name](spark, SF).count()
    table = {"op2": "pages", "op8": None, "op9": None, "op11": None, "op12": None}.get(name.split("_")[0], "documents")
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else n > 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS size", "2 AS kept")
    n = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "kept"]
        if i < 3:
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.where("n_tokens > 0").count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_search_with_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [0.0, 2.0]), (3, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (100, [2.0])]
    base = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, id int, score int")
    got = topk.search(base, base.where("vec_id % 50 = 0"), "vec_id", "embedding", k=2, scale=1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"] or 0, r["score"]) for r in got) == sorted(
        [(50, 1, 100, 2), (50, 2, 0, 1), (50, 1, 0, 0), (50, 2, 3, 0), (100, 1, 0, 2), (100, 2, 3, 2)]
    )


def test_search_refuses_scores_beyond_53_bits(spark):
    base = spark.createDataFrame([(50, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*53"):
        topk.search(base, base.where("vec_id = 50"), "vec_id", "embedding").collect()


def test_conversations_and_nodes_without_ids(spark):
    rows = [(None, 1, None, "user", "a"), (None, 2, 1, "assistant", "b"), (7, None, None, "user", "c"), (8, 1, None, None, None)]
    nodes = spark.createDataFrame([(*r, 0.0) for r in rows], "conv long, node long, parent int, role string, text string, score double")
    got = {r["conv"]: r["formatted"] for r in chat.format_conversations(nodes).collect()}
    assert got == {None: "<s>[user]a</s><s>[assistant]b</s>", 7: "<s>[user]c</s>", 8: "<s>[]</s>"}
