"""Deterministic inputs for the operators, derived from the driver's tables.

The driver's data has no books, so parts are taken as index entries (brand = book,
size = page), documents as pages, and conversations as argument maps.  What is derived
in SQL here is the same text that the reference SQL of the queries uses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.storage import remove, shared_folder

INITIALS = "upper(substr(p_name, 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1))"
TERM = f"""CASE p_partkey % 5
  WHEN 0 THEN p_name
  WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2)
  WHEN 2 THEN p_name || ' (' || {INITIALS} || ')'
  WHEN 3 THEN {INITIALS}
  ELSE lower(p_type) || ' ' || p_name END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, title, author, year, pdf_path, text_path, md_path, book_ord: one for each brand."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct()
    year = F.lit(1990) + F.regexp_extract("key", r"(\d+)$", 1).cast("int")
    none = F.lit(None).cast("string")
    return numbered(brands, [(F.col("key"), False)], "book_ord").select("key", F.concat(F.lit("Book "), "key").alias("title"), F.concat(F.lit("Author "), F.substring("key", -1, 1)).alias("author"), year.alias("year"), none.alias("pdf_path"), none.alias("text_path"), none.alias("md_path"), "book_ord")


def index(spark: SparkSession, sf_dir: str, emptied: bool = False) -> DataFrame:
    """book_key, book_ord, term, term_ord, pages; with emptied, the plain names of some books lack pages."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_key"), F.expr(TERM).alias("term"), "p_partkey", F.col("p_size").cast("string").alias("page"), "p_name")
    rows = part.groupBy("book_key", "term").agg(F.min("p_partkey").alias("term_ord"), F.array_sort(F.collect_set("page")).alias("pages"), F.max((F.col("term") == F.col("p_name")).cast("int")).alias("plain"))
    if emptied:
        rows = rows.withColumn("pages", F.when((F.col("plain") == 1) & (F.col("term_ord") % 3 == 0), F.array().cast("array<string>")).otherwise(F.col("pages")))
    keys = books(spark, sf_dir).select(F.col("key").alias("book_key"), "book_ord")
    return rows.join(keys, "book_key").select("book_key", "book_ord", "term", "term_ord", "pages")


_kept: dict = {}


def kept(name: str, make):
    """make as a table that is written once for its session and input folder, as an engine's relations are."""
    place = written(name, lambda spark, sf_dir, folder: make(spark, sf_dir).write.parquet(folder))
    return lambda spark, sf_dir: spark.read.parquet(place(spark, sf_dir))


def written(name: str, write):
    """A folder of the shared store that write(spark, sf_dir, folder) fills once for its session and input folder."""

    def folder(spark: SparkSession, sf_dir: str) -> str:
        key = name, spark.sparkContext.applicationId, sf_dir
        if key not in _kept:
            place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
            write(spark, sf_dir, place)
            _kept[key] = spark, place
        return _kept[key][1]

    return folder


def forget() -> None:
    """Drops all relations that are kept, so that the next query builds its own."""
    for spark, folder in _kept.values():
        remove(spark, folder)
    _kept.clear()


#: The index and the lookup's order, for reference SQL: occ(book_key, term, page, first), terms(term, n_books, ord).
OCC_SQL = f"""
WITH rows AS (SELECT p_brand AS book_key, {TERM} AS term, CAST(p_size AS VARCHAR) AS page, p_partkey, p_name FROM part),
occ AS (SELECT book_key, term, min(p_partkey) AS first_key, list_sort(list(DISTINCT page)) AS pages, max(CAST(term = p_name AS INT)) AS plain FROM rows GROUP BY book_key, term),
terms AS (SELECT term, count(*) AS n_books, row_number() OVER (ORDER BY count(*) DESC, lower(term), min(book_key || chr(1) || lpad(CAST(first_key AS VARCHAR), 12, '0')), term) AS ord FROM occ GROUP BY term)
"""
