"""Corpus preparation: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept. Each result is written as Parquet to the shared folder
and read again, so a lost executor repeats one stage at most. All stages but
the last return the columns of ``documents``; the last returns token ids.

A stage keeps columns that it does not know, and recomputes ``n_chars`` where
it changes a text. Null ids, texts, languages and sources pass as the
operators say; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm import bpe, jaccard, mixing, quality, suffixarray
from rowloom.llm.queries import tokenizer_path
from rowloom.session import materialize

_P = "__stage_"
#: Shortest repeated passage that is cut out: fifty words of four letters or fewer still fill it.
PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or lie far from their language and source go."""
    marked = docs.withColumn(_P + "id", F.struct("doc_id", F.xxhash64("text").alias("th")))
    kept = quality.judge(marked, id_col=_P + "id").where("kept")
    passed = kept.select(F.col(f"{_P}id.doc_id").alias(_P + "id"), F.col(f"{_P}id.th").alias(_P + "key")).distinct()
    keyed = docs.withColumn(_P + "th", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(passed[_P + "id"]) & (keyed[_P + "th"] == passed[_P + "key"])
    return keyed.join(passed, same, "left_semi").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, those without an id coming last.

    Documents are told apart by id and text, so other texts under the same id
    are judged by themselves; of rows equal in both, the smallest stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    found = materialize(jaccard.near_duplicates(docs.select(key.alias(_P + "id"), "text"), id_col=_P + "id"))
    own = found.where(f"{_P}id = component_id OR n_shingles = 0").groupBy(F.col(_P + "id").alias(_P + "key"))
    own = materialize(own.agg(F.count("*").alias(_P + "n"), F.max("n_shingles").alias(_P + "size")))
    keyed = docs.withColumn(_P + "id", key)
    kept = keyed.join(own, keyed[_P + "id"] == own[_P + "key"])
    again = F.col(_P + "n") > 1
    one = Window.partitionBy(_P + "id").orderBy("source", "lang")
    first = kept.where(again & (F.col(_P + "size") > 0)).withColumn(_P + "row", F.row_number().over(one)).where(F.col(_P + "row") == 1)
    return kept.where(~again | (F.col(_P + "size") == 0)).select(*docs.columns).unionByName(first.select(*docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_BYTES`` that start anywhere else are cut out; documents left without a word go."""
    marked = docs.withColumn(_P + "id", F.struct("doc_id", F.xxhash64("text").alias("th")))
    cut = suffixarray.dedupe_bytes(marked, id_col=_P + "id", window=PASSAGE_BYTES).where("n_removed > 0")
    # A cut inside a character leaves bytes that are no text; they are dropped.
    left = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    cut = cut.select(F.col(f"{_P}id.doc_id").alias(_P + "id"), F.col(f"{_P}id.th").alias(_P + "key"), left.alias(_P + "text"))
    cut = materialize(cut.dropDuplicates([_P + "id", _P + "key"]))
    keyed = docs.withColumn(_P + "th", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(cut[_P + "id"]) & (keyed[_P + "th"] == cut[_P + "key"])
    joined = keyed.join(cut, same, "left")
    changed = F.col(_P + "key").isNotNull()
    joined = joined.withColumn("text", F.when(changed, F.col(_P + "text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.where(~changed | (mixing.size_of(F.col("text")) > 0)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.draw(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document row."""
    return bpe.encode_documents(docs, tokenizer_path(), lasting=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding", encoded),
]

#: The stages estimate scatter, link documents and tokenize; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
