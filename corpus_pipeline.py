"""The training-corpus pipeline: language, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  The first four
return the columns of documents with the rows they keep; the last returns the packed
pieces.  Stages are written as Parquet and read again by the next one.

A language is rejected where it is undetermined; a text is rejected where its
toxicity score reaches the threshold; of each group of near duplicates the row with
the smallest doc_id stays (repeated rows count once); a document that an item of the
benchmark leaks into goes whole.  Every decision is a row's own: rows of one doc_id with
different texts are judged apart, and rows with a null doc_id like all others (in a
group of near duplicates one of them stays only where no row has a doc_id).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import decontamination, language_id, packing, toxicity
from lexgrove.llm.columns import every, fresh
from lexgrove.llm.graph import durable, remove, shared_folder
from lexgrove.llm.jaccard_join import jaccard_components
from lexgrove.llm.queries import fold, table, tokenizer_path

#: Near duplicates share 80 per cent of their five-word shingles or more; op10's contract has its own figures.
NEAR_WORDS, NEAR_LEAST = 5, 80
#: Rows without a doc_id are numbered from here on by their text.
NO_ID = 1 << 62


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~fold(4, 2)))
    names = fresh(docs, "found_language"), fresh(docs, "found_score")
    found = language_id.identify(docs, model, tuple(docs.columns), names)
    return found.where(F.col(names[0]) != "und").select(*every(docs.columns))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~fold(3, 1)))
    name = fresh(docs, "found_score")
    return toxicity.score(docs, model, tuple(docs.columns), name).where(F.col(name) < toxicity.THRESHOLD).select(*every(docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is known by its doc_id and a hash of its text; null ids stand behind all others
    mark = F.xxhash64(F.col("text").cast("string"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).bitwiseOR(F.shiftrightunsigned(mark, 2)))
    named = docs.select(number.alias("doc_id"), "text")
    found = durable(jaccard_components(named, k=NEAR_WORDS, least=NEAR_LEAST, tag=mark))
    rows, tag = fresh(docs, "row_number"), fresh(docs, "row_tag")
    keyed = docs.withColumns({rows: number, tag: mark})
    others = found.where("doc_id <> component_id OR tag <> component_tag").select(F.col("doc_id").alias(rows), F.col("tag").alias(tag)).distinct()
    kept = keyed.join(others, [rows, tag], "left_anti")
    # equal rows are one; there is nothing to compare where no doc_id and text come again
    again = found.groupBy(F.col("doc_id").alias(rows), F.col("tag").alias(tag)).count().where("count > 1").select(rows, tag)
    if not again.isEmpty():
        kept = kept.join(again, [rows, tag], "left_anti").union(kept.join(again, [rows, tag], "left_semi").dropDuplicates([rows, tag]))
    return kept.select(*every(docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language id", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]
#: Trained models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps lies in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage before kept is not read again
            remove(spark, f"{folder}/{k - 1}")
    return docs
