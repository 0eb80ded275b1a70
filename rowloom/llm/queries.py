"""The operators of this subpackage as queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm import bpe, chat, htmltree, jaccard, langid, licenses, mixing, prefixtrie, quality, spelling, suffixarray, suffixtree, topk

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        LLM_QUERIES[name] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            LLM_ORACLES[name] = sql
        return build

    return keep


def _crc32(s: str) -> str:
    """SQL: CRC-32 of a text's UTF-8, bit by bit."""
    octet = f"('0x' || substr(hex(encode({s})), (2 * i + 1)::int, 2))::bigint"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode({s}))), lambda i: {octet})), lambda c, b: {step}), 4294967295)"


def tokenizer_path() -> str:
    """The public tokenizer file; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_language_id")
def op1(table):
    docs = table("documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    held = F.coalesce(part == 2, F.lit(False))
    fitted = langid.learn(docs, part == 3, taught=~held)
    found = langid.identify(docs, fitted, costs=fitted.costs)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query("op2_html_main_text")
def op2(table):
    out = htmltree.extract_main_text(table("pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_bpe_encode")
def op3(table):
    out = bpe.encode_documents(table("documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_quality_rules")
def op4(table):
    return quality.judge(table("documents")).drop("distance")


@query("op6_jaccard_join")
def op6(table):
    return jaccard.near_duplicates(table("documents"))


@query("op7_mix_sources")
def op7(table):
    return mixing.mix(table("documents")).drop("copies")


_OP8_SQL = """
WITH ready AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0
), asked AS (
  SELECT DISTINCT vec_id AS query_id, v AS q FROM ready WHERE vec_id % 50 = 0
), scored AS (
  SELECT query_id, q, vec_id, coalesce(list_sum(list_transform(list_zip(q, v), lambda p: p[1] * p[2])), 0)::bigint AS score
  FROM asked JOIN ready ON vec_id IS DISTINCT FROM query_id
)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id NULLS FIRST) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op8_exact_top_k", _OP8_SQL)
def op8(table):
    rows = table("embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding")


_OP9_SQL = """
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), told AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
    sum(9 + length(replace(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))) AS size
  FROM told GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::bigint AS loss_chars, sha256(loss) AS loss_sha256, size::bigint AS formatted_chars
FROM whole
"""


@query("op9_chat_format", _OP9_SQL)
def op9(table):
    rows = table("conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = rows.sparkSession.createDataFrame([(-1, i, r, tricky) for i, r in enumerate(("user", "assistant"))], rows.schema)
    rows = rows.unionByName(own)
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select(F.col("conv_id").alias("conv"), node.alias("node"), "role", "text")
    thread = rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    done = chat.format_conversations(thread)
    done = done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op5_substring_dedup")
def op5(table):
    out = suffixtree.dedupe_passages(table("documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_suffix_array_dedup")
def op10(table):
    out = suffixarray.dedupe_bytes(table("documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_license_scan")
def op13(table):
    return licenses.scan_licenses(table("documents")).drop("detections")


_OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::varchar, '') || ':' AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS run FROM documents
), low AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs
), hashed AS (
  SELECT run, c, {_crc32("id || run")} AS h FROM (SELECT id, run, count(*) AS c FROM low GROUP BY ALL)
), cut AS (
  SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), vocab AS (
  SELECT word, sum(c)::bigint AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.v = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * v.n THEN b.near_n END AS form_n,
         CASE WHEN b.near_n >= 10 * v.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = v.word AND p.n = b.near_n) END AS form
  FROM vocab v LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.at WHERE e.form IS NULL
"""


@query("op12_spelling_variants", _OP12_SQL)
def op12(table):
    return spelling.group_variants(table("documents"))


_OP11_SQL = f"""
WITH RECURSIVE own AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv, conv - conv % 20 AS base, {_crc32("conv::varchar")} % 4 AS h FROM (SELECT DISTINCT conv FROM own)
), taken AS (
  SELECT s.conv, o.pos, o.role, o.text FROM heads s JOIN own o ON o.conv = s.base AND o.pos <= s.h
), turns AS (
  SELECT * FROM taken
  UNION ALL SELECT o.conv, o.pos - s.h + (SELECT count(*) FROM taken t WHERE t.conv = o.conv), o.role, o.text FROM own o JOIN heads s USING (conv) WHERE o.pos > s.h
), member AS (
  SELECT conv, pos AS depth, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv ORDER BY pos) AS prefix,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turns
  UNION ALL SELECT conv, 0, '', 0 FROM heads
), node AS (
  SELECT prefix, depth, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM member GROUP BY ALL
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.prefix AS above FROM node n LEFT JOIN node p ON p.prefix = left(n.prefix, greatest(length(n.prefix) - 64, 0)) AND p.depth = n.depth - 1
), kids AS (
  SELECT above AS prefix, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1
), reach AS (
  SELECT prefix AS node, above, saved, depth, CASE WHEN prefix IN (SELECT prefix FROM kids) THEN 0 ELSE 1 END AS leaf, prefix AS top FROM linked
  UNION ALL SELECT r.node, l.above, r.saved, l.depth, r.leaf, l.prefix FROM reach r JOIN linked l ON l.prefix = r.above WHERE r.depth > 0
), total AS (
  SELECT top AS prefix, sum(leaf)::bigint AS n_leaves, sum(saved)::bigint AS saved_tokens FROM reach GROUP BY 1
), ends AS (
  SELECT prefix, string_agg(conv::varchar, ',' ORDER BY conv) AS ids FROM (SELECT conv, max_by(prefix, depth) AS prefix FROM member GROUP BY conv) GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM linked LEFT JOIN kids USING (prefix) JOIN total USING (prefix) LEFT JOIN ends USING (prefix)
"""


@query("op11_prefix_trie", _OP11_SQL)
def op11(table):
    turns = prefixtrie.numbered(table("conversations"))
    convs = turns.select("conv").distinct()
    return prefixtrie.prefix_trie(convs, prefixtrie.with_shared_starts(convs, turns))
