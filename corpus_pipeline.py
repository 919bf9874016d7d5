"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on, with the columns of ``documents``; the last
returns packed pieces.  Between stages the rows are written as Parquet and
read again, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import langid, ngram_join, packing, quality, suffix_dedup
from siftline.llm.storage import free_name, written
from siftline.llm.vocab import public

#: Documents whose language scores less are rejected.
LEAST_SCORE = 0.5
#: So are those whose letters are so many times as unlikely as those of their language (its own prose: about 1).
STRANGEST = 3.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, those of no clear language, and those like no language learned.

    The score alone hardly rejects any, as it only weighs languages against
    each other; so the likelihood of a letter is held against that in the
    language's own documents.
    """
    model = langid.train(docs, public("byte_bpe_multi_50k.tiktoken"))
    lang, score, strange = (free_name(docs, c) for c in ("lang", "score", "strange"))
    predicted = langid.predict(docs, model, out=lang, score=score, strange=strange)
    return predicted.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE) & (F.col(strange) <= STRANGEST)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or whose n-grams are unlike those of trusted documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays.

    Rows that repeat an id with different texts are documents of their own, in
    the order of id and a hash of the text; of rows with equal id and text one
    stays; rows without id all stay.
    """
    named = docs.filter("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = ngram_join.ngram_components(docs.select("doc_id", "text"))
        gone = written(found.filter("doc_id != component_id").select("doc_id"), "gone")
        return docs.join(F.broadcast(gone) if gone.count() <= ngram_join.IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    key = free_name(docs, "key")
    keyed = named.withColumn(key, ngram_join.node("doc_id", "text"))
    found = ngram_join.linked(keyed.select(F.col(key).alias("id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    placed = keyed.select(key, "doc_id").join(found.distinct(), key)
    stay = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("x")).select(f"x.{key}")
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings from the texts; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    return packing.pack(docs, public("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", suffix_array),
    ("packing", pack),
]

#: Language models and suffix orders have no form in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
