"""Tokens, languages, pages and quality rules."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from rowloom.llm import bpe, htmltree, langid, quality
from rowloom.llm.queries import tokenizer_path

ODD = "aAbéßΣσİıǅ \t\n\x0b\x1c\x85\xa0'ſst<|>0１½²中文한ก็é́̈​　😀__--.!"


def test_tokens_as_the_library_gives_them():
    from tokenizers import Tokenizer

    pick = random.Random(1)
    texts = ["".join(pick.choice(ODD) for _ in range(pick.randrange(60))) for _ in range(1500)]
    parts = ["the", "ing", "tion", "un", "able", "er", "qu", "xz", "q", "ly", "ment", "ZZ"]
    texts += ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 9))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|> y", "", " ", "a" * 5000, "ab" * 3000, "it's I'LL don't", "ΑΣ ΟΔΟΣ"]
    library, own = Tokenizer.from_file(tokenizer_path()), bpe.Tokenizer(tokenizer_path())
    for text, got in zip(texts, own.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), text


def test_short_and_long_merging_agree():
    own = bpe.Tokenizer(tokenizer_path())
    pick = random.Random(2)
    for _ in range(300):
        start = own.start("".join(pick.choice("abcdefghinorstu") for _ in range(pick.randrange(1, 30))) + own.end)
        assert own.merge(start) == own._merge_long(start)


def test_documents_without_text_have_no_tokens(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", 5)], "doc_id long, text string, ids int")
    got = {(r["doc_id"], r["n_tokens"], r["ids"]) for r in bpe.encode_documents(docs, tokenizer_path()).collect()}
    assert {x[:2] for x in got} == {(1, 0), (2, 0), (None, 2)}
    assert bpe.encode_documents(docs.limit(0), tokenizer_path()).count() == 0


@pytest.fixture(scope="module")
def speech():
    pick = random.Random(3)
    sounds = {"en": ["the", "ing", "and", "wh", "sh"], "de": ["sch", "ung", "ein", "ä", "ch"], "fr": ["eau", "que", "é", "oi", "ç"]}
    say = lambda lang, n: " ".join("".join(pick.choice(sounds[lang]) for _ in range(pick.randrange(1, 4))) for _ in range(n))
    return [(i, say(lang, pick.randrange(3, 60)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]


def test_languages_of_held_out_texts(spark, speech):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([*speech, (900, None, "en"), (901, "", None), (902, "12 !?", "de"), (903, "the and", None)], "doc_id long, text string, lang string")
    fitted = langid.learn(docs.where("doc_id % 4 <> 2"), F.col("doc_id") % 4 == 3)
    got = {r["doc_id"]: r for r in langid.identify(docs, fitted).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in speech if i % 4 == 2]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "the", None), (2, None, "en")], "doc_id long, text string, lang string")
    fitted = langid.learn(docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, fitted).collect()} == {"und"}


def bits_by_definition(words, text):
    """Kneser-Ney cross-entropy per character, straight from the definition."""
    from math import log2

    windows = lambda ws: [(" " * 4 + w + " ")[i : i + 5] for w in ws for i in range(len(w) + 1)]
    levels = {5: Counter(windows(words))}
    for k in range(4, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    letters = len(levels[1]) + 1

    def p(gram):
        if not gram:
            return 1 / letters
        level = levels[len(gram)]
        once, twice = (sum(v == n for v in level.values()) for n in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        same = [v for g, v in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(level[gram] - d, 0) / sum(same) + (1 - sum(max(v - d, 0) for v in same) / sum(same)) * p(gram[1:])

    cost = [-log2(max(p(g), 1e-9)) for g in windows(text.split())]
    return sum(cost) / len(cost)


@pytest.mark.parametrize("room", [0, 200, langid.COMMON_BYTES])
def test_entropies_by_definition(spark, room):
    taught = {"a": "anna banana ananas nab anna", "b": "bob nab abba bob bob éa"}
    docs = spark.createDataFrame([(x, False, t) for x, t in taught.items()], "lang string, held boolean, text string")
    model = langid.build_model(langid.count_grams(docs, ("lang",)))
    texts = ["anna nab", "bob", "zebra anna anna éé", "", None, "1 2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["bits"] for r in langid.entropies(rows, model, ("id",), room).collect()}
    assert model.langs == ["a", "b"] and got[3] is None and got[4] is None and got[5] is None
    for i, text in enumerate(texts[:3]):
        assert got[i] == pytest.approx([bits_by_definition(taught[x].split(), text) for x in model.langs])


def test_odd_rows_of_languages(spark, speech):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(speech, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("id", "bits", "word", "h", "n", "row", "held", "gram")})
    fitted = langid.learn(docs, F.col("doc_id") % 4 == 3)
    odd = [(1, "²½ ③ Ⅳ"), (None, "the and"), (2, "schung"), (2, "schung"), (3, "the " * 200_000), (4, "sch" * 100_000), (5, "sch²ung")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "bits", "sums", "size", "rare", "lang")})
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in langid.identify(rows, fitted).collect()))
    assert got == [(0, "en"), (1, "und"), (2, "de"), (2, "de"), (3, "en"), (4, "de"), (5, "de")]
    assert langid.identify(rows.limit(0), fitted).count() == 0


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>"</script></head><body>{extra}{body}</body></html>'


def test_article_text_by_markup():
    source = page(
        '<article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>\n  word<p>Two&nbsp;x &lt;y&gt;<div class="ad">buy</div>'
        '<aside>side</aside><section id="comments"><p>first!</p></section><form>mail</form></article>',
        '<nav><a href="/">Home</a></nav><header>Site</header><div class="cookie-notice">ok?</div><!-- c -->',
    )
    assert htmltree.main_text(source + "<footer>end</footer>", set()) == "Head & more\nOne bold word\nTwo x <y>"
    assert htmltree.main_text(None, set()) == htmltree.main_text("", set()) == ""
    assert htmltree.main_text("<p>open <b>never closed", set()) == "open never closed"


def test_branches_that_repeat_on_a_host_go(spark):
    rows = []
    for i in range(12):
        body = f'<div class="top">Our best shop</div><div class="story"><p>Story {i} begins.</p><p>Same words.</p><p>End of {i}</p></div><div class="legal">All rights</div>'
        rows.append((i, f"http://Shop.example:80/{i}", page(body)))
    rows += [(100, "http://other.example/", page("<div>alone</div>")), (101, None, None), (102, "no url", ""), rows[0]]
    got = {r[0]: r[2] for r in htmltree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 begins.\nSame words.\nEnd of 3"
    assert (got[100], got[101], got[102]) == ("alone", "", "")


def test_article_tags_do_not_decide_alone(spark):
    rows = []
    for i in range(12):
        inside = f'<article><p>Story {i} begins.</p><p>Same words.</p><div class="box">Read on elsewhere</div></article>'
        rows.append((i, f"http://a.example/{i}", page(inside)))
        beside = f'<article class="teaser"><p>New today</p></article><div class="story"><p>Tale {i} begins.</p></div>'
        rows.append((100 + i, f"http://b.example/{i}", page(beside)))
    rows.append((200, "http://c.example/", page("<article>teaser</article><div>story</div>")))
    got = {r[0]: r[2] for r in htmltree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 begins.\nSame words."
    assert got[103] == "Tale 3 begins."
    assert got[200] == "teaser\nstory"


def test_junk_goes_and_clean_texts_stay(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 9)))
    clean = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(pick.randrange(2, 20))), "en", f"s{i % 2}") for i in range(200)]
    junk = [(500 + i, " ".join(word() + "***" for _ in range(80)), "en", "s0") for i in range(8)]
    lines = [(600, "\n".join(f"the same line of text {i % 2} here" for i in range(8)), "en", "s1"), (601, None, None, None), (602, "too short", "en", "s0")]
    docs = spark.createDataFrame([*clean, *junk, *lines, clean[0]], "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert not any(kept[i] for i, *_ in [*junk, *lines])
    assert sum(kept[i] for i, *_ in clean) == 200
    assert quality.judge(docs.limit(0)).count() == 0


def test_tokenizer_file_is_not_copied():
    assert not os.path.abspath(tokenizer_path()).startswith(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) + os.sep)


def test_kept_results_are_small_and_can_go(spark):
    t = bpe.Tokenizer(tokenizer_path())
    first = t.encode(["one two three", "", "two 3,14 two"])
    assert t.chunks and all(isinstance(v, bytes) and len(v) % 4 == 0 for v in t.chunks.values())
    assert len(t.chunks["two"]) == 4 and first[1] == (0, "", "")
    t.forget()
    assert not t.chunks and not t.older and t.held == 0
    assert t.encode(["one two three", "", "two 3,14 two"]) == first
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in bpe.encode_documents(docs, tokenizer_path(), lasting=False).collect()}
    assert rows == {1: first[0][:2], 2: (0, "")}


def test_texts_are_encoded_in_small_parts():
    """A worker has the chunks, ids and tokens of few texts in memory at once."""
    docs = type("Docs", (), {"schema": T.StructType([T.StructField("doc_id", T.LongType())]), "selectExpr": lambda self, *c: self})()
    docs.mapInArrow = lambda work, ddl: type("Rows", (), {"withColumnRenamed": lambda self, a, b: work})()
    texts = [None if i % 7 == 0 else f"Some text {i}, über {i % 3}" for i in range(450)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(450)), pa.array(texts)], ["id", "text"])
    out = list(bpe.encode_documents(docs, tokenizer_path(), lasting=False)(iter([batch])))
    assert max(b.num_rows for b in out) <= 100
    alone = bpe.Tokenizer(tokenizer_path())
    rows = [tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()]
    assert rows == [(i, *alone.encode([t or ""])[0]) for i, t in enumerate(texts)]
