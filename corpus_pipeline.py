"""The pipeline of a training corpus; each stage calls one operator of tidemark.llm.

Every stage but the last returns the columns of documents. Each works on all rows its predecessor
kept; n_chars follows the text where a stage changes it. Rows that a stage drops: texts in no
language (null, or without a letter); toxic texts (score of 0.5 or more); all but one of each group
of near copies (the smallest doc_id stays). Line dedup drops no document: one whose lines all repeat
earlier ones stays as an empty text, which the later stages keep and pack as its end token alone.

Nulls in any column, repeated rows and null or repeated doc_ids go through every stage; other columns
than those of documents are left behind, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, ngram_join, packing, toxicity
from tidemark.llm.common import Scratch, prepare
from tidemark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_some_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows of its input; without any, all texts with a letter stay."""
    model = language_id.learn(docs)
    if not model[0]:
        return language_id.with_letter(spark, docs.select(*COLUMNS))
    found = language_id.predict(spark, docs.select(*COLUMNS[:1], *COLUMNS[2:], F.col("text").alias("kept"), "text"), model)
    return found.filter(F.col("lang_pred") != language_id.UND).select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(spark, docs.select(*COLUMNS[:1], *COLUMNS[2:], F.col("text").alias("kept"), "text"), model)
    return found.filter("predicted = 0").select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(spark, docs.select(*COLUMNS), least_words=line_dedup.ALL_LINES)
    return found.withColumn("n_chars", F.when(F.col("removed_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are known by a hash of doc_id and text. The least doc_id of a group stays (null ids last), once; rows without a word are in no group."""
    scratch = Scratch(spark, "groups")
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("_row"))
    found = ngram_join.jaccard_components(spark, rows.select(F.col("_row").alias("doc_id"), "text"))
    group = found.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("group")).withColumnRenamed("doc_id", "_row")
    ids = rows.groupBy("_row").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    placed = scratch.write(ids.join(group, "_row"), "placed")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("first"), F.sum("copies").alias("size")).filter("size > 1")
    marks = placed.join(first, "group").select("_row", (F.col("_row") != F.col("first._row")).alias("away"), "copies").filter("away or copies > 1")
    marks = scratch.write(marks, "marks")
    scratch.drop("placed")
    one = rows.join(marks.filter("not away"), "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("kept")).select("kept.*")
    return rows.join(marks, "_row", "left_anti").select(*COLUMNS).union(one)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", in_some_language),
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("packing", packed),
]

#: The stages' models and tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    prepare(spark)
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
