"""The relations' schemas, their tables in a catalog, and queries that check their constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "books": "key STRING NOT NULL, title STRING NOT NULL, author STRING NOT NULL, year INT NOT NULL, pdf_path STRING, text_path STRING, md_path STRING",
    "terms": "id BIGINT NOT NULL, term STRING NOT NULL, n_books INT NOT NULL",
    "occurrences": "term_id BIGINT NOT NULL, book_key STRING NOT NULL, pages ARRAY<STRING> NOT NULL",
    "candidates": "term1_id BIGINT NOT NULL, term2_id BIGINT NOT NULL, match_type STRING NOT NULL, score DOUBLE NOT NULL",
    "chapters": "id BIGINT NOT NULL, book_key STRING NOT NULL, title STRING NOT NULL, start_book_page INT, end_book_page INT, ref_line INT",
    "references": "id BIGINT NOT NULL, chapter_id BIGINT NOT NULL, authors STRING, year INT, title STRING, venue STRING, raw STRING NOT NULL",
    "term_chapters": "term_id BIGINT NOT NULL, chapter_id BIGINT NOT NULL",
}
UNIQUE = {"books": ("key",), "terms": ("term",), "occurrences": ("term_id", "book_key"), "term_chapters": ("term_id", "chapter_id")}
FOREIGN = (
    ("occurrences", "term_id", "terms", "id"),
    ("occurrences", "book_key", "books", "key"),
    ("candidates", "term1_id", "terms", "id"),
    ("candidates", "term2_id", "terms", "id"),
    ("chapters", "book_key", "books", "key"),
    ("references", "chapter_id", "chapters", "id"),
    ("term_chapters", "term_id", "terms", "id"),
    ("term_chapters", "chapter_id", "chapters", "id"),
)


def create(spark: SparkSession, database: str = "default") -> None:
    """All tables, where they are not there yet."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def drop(spark: SparkSession, database: str = "default") -> None:
    """All tables, the dependent ones first."""
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def load(spark: SparkSession, relations: dict[str, DataFrame], database: str = "default") -> None:
    """Replaces the rows of the given tables."""
    for name, df in relations.items():
        wanted = spark.table(f"`{database}`.`{name}`").schema
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")


def violations(relations: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n): how many rows or keys break a rule; rules that hold are left out.

    Rules: unique keys, references to other tables, candidates of two different terms.
    """
    found = []

    def told(df: DataFrame, table: str, rule: str) -> None:
        found.append(df.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n"))

    for table, keys in UNIQUE.items():
        if table in relations:
            told(relations[table].groupBy(*keys).count().where("count > 1"), table, f"unique({', '.join(keys)})")
    for table, column, other, key in FOREIGN:
        if table in relations and other in relations:
            known = relations[other].select(F.col(key).alias("_known"))
            told(relations[table].join(known, F.col(column) == F.col("_known"), "left_anti"), table, f"{column} in {other}")
    if "candidates" in relations:
        told(relations["candidates"].where("term1_id = term2_id"), "candidates", "term1_id <> term2_id")
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.where("n > 0")


def unknown_keys(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Keys (book_key) that the registry does not have."""
    return asked.select("book_key").distinct().join(registry.select("book_key"), "book_key", "left_anti")
