"""Sinks: tables by book as Parquet, and the documents that leave the engine as JSON or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import exists

#: A book's label takes so many characters at least.
LABEL_WIDTH = 30


def by_book(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """A table (index, page markers, chapters, references) in a folder for each book."""
    df.write.mode(mode).partitionBy("book_key").format(form).save(path)


def whole(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """A table (lookup, candidates, linked lookup) in one folder."""
    df.write.mode(mode).format(form).save(path)


def lookup_json(maps: DataFrame, path: str) -> None:
    """The lookup as lines of JSON {term, n_books, books, pages}, in its order."""
    maps.orderBy("ord").drop("ord").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown_files(documents: DataFrame, path: str) -> None:
    """book_key, markdown as a text file in a folder for each book."""
    documents.where("markdown IS NOT NULL").select("book_key", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("book_key").text(path)


def text_files(texts: DataFrame, path: str, force: bool = False) -> None:
    """book_key, text in a folder for each book; books that have one already are left alone unless forced to."""
    rows = texts.where("text IS NOT NULL").select("book_key", F.col("text").alias("value"))
    spark = texts.sparkSession
    if not force and exists(spark, path):
        held = spark.read.text(path)
        if "book_key" in held.columns:
            rows = rows.join(held.select(F.col("book_key").cast("string")).distinct(), "book_key", "left_anti")
    rows.write.mode("append" if not force else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_key").text(path)


def binary_files(contents: DataFrame, path: str) -> None:
    """book_key, content (bytes) as a file in a folder for each book; a line end follows the bytes."""
    contents.where("content IS NOT NULL").select("book_key", F.col("content").cast("string").alias("value")).write.mode("overwrite").partitionBy("book_key").text(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON string."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def hit_lines(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits as text: a line for the term (after its mark, where it has one) and one for each book with its pages."""
    marked = hits if "mark" in hits.columns else hits.withColumn("mark", F.lit(None).cast("string"))
    rows = marked.select("term", "n_books", "mark", F.explode_outer("pages").alias("key", "own")).join(labels, "key", "left")
    name = F.coalesce("label", "key")
    entry = F.concat(F.lit(" " * 6), name, F.repeat(F.lit(" "), F.greatest(F.lit(0), LABEL_WIDTH - F.length(name))), F.lit("  pp. "), F.coalesce(F.nullif(F.array_join("own", ", "), F.lit("")), F.lit("—")))
    head = F.concat(F.lit("  "), F.coalesce(F.concat(F.lit("["), F.col("mark"), F.lit("] ")), F.lit("")), F.col("term"), F.lit("  ("), F.col("n_books").cast("string"), F.when(F.col("n_books") == 1, " book)").otherwise(" books)"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", entry.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("term", "n_books", "mark").agg(F.concat_ws("\n", head, F.nullif(lines, F.lit(""))).alias("text"))
