"""Merging per-book indices into one lookup, and loading it as relations.

An index is a long table (book_key, book_ord, term, term_ord, pages array<string>)
with one row for each book and term; a lookup keeps that long form, with every term's
place in the lookup's order.  Maps are only made where results leave the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered


def build_lookup(index: DataFrame, with_subentries: bool = False, fill: bool = True) -> DataFrame:
    """(ord, term, n_books, book_key, book_ord, pages), ord by books (most first), lower-case term, first sight.

    Terms with ">" are sub-entries and left out unless asked for.  With fill, a term
    without pages in a book takes those of the terms that begin with it and a space.
    """
    rows = index if with_subentries else index.where(~F.contains(F.col("term"), F.lit(">")))
    rows = rows.select("book_key", "book_ord", "term", "term_ord", "pages")
    terms = rows.groupBy("term").agg(F.countDistinct("book_key").alias("n_books"), F.min(F.struct("book_ord", "term_ord")).alias("seen"))
    ranked = numbered(terms, [(F.col("n_books"), True), (F.lower("term"), False), (F.col("seen.book_ord"), False), (F.col("seen.term_ord"), False), (F.col("term"), False)])
    pages = fill_subentries(rows, index) if fill else rows
    return pages.join(ranked, "term").select("ord", "term", "n_books", "book_key", "book_ord", "pages")


def fill_subentries(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows, with empty pages filled from the index terms of the same book that continue the term.

    Every index term is opened into its prefixes that end before a space; a prefix
    join becomes an equi-join.  Pages keep the index order, each once.
    """
    empty = rows.where(F.size("pages") == 0).select("book_key", F.col("term").alias("prefix"))
    spaces = F.filter(F.sequence(F.lit(1), F.length("term")), lambda i: F.substr("term", i, F.lit(1)) == " ")
    opened = index.where((F.size("pages") > 0) & F.contains(F.col("term"), F.lit(" "))).select("book_key", "term_ord", "pages", F.explode(F.transform(spaces, lambda i: F.substr("term", F.lit(1), i - 1))).alias("prefix"))
    found = empty.join(opened, ["book_key", "prefix"]).select("book_key", "prefix", "term_ord", F.posexplode("pages").alias("at", "page"))
    first = found.groupBy("book_key", "prefix", "page").agg(F.min(F.struct("term_ord", "at")).alias("seen"))
    filled = first.groupBy("book_key", F.col("prefix").alias("term")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "page"))), lambda x: x["page"]).alias("filled"))
    return rows.join(filled, ["book_key", "term"], "left").withColumn("pages", F.when(F.size("pages") == 0, F.coalesce("filled", "pages")).otherwise(F.col("pages"))).drop("filled")


def lookup_maps(lookup: DataFrame) -> DataFrame:
    """One row for each term: ord, term, n_books, books in book order, pages by book."""
    entries = F.array_sort(F.collect_list(F.struct("book_ord", "book_key", "pages")))
    packed = lookup.groupBy("ord", "term", "n_books").agg(entries.alias("e"))
    return packed.select("ord", "term", "n_books", F.transform("e", lambda x: x["book_key"]).alias("books"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["book_key"], x["pages"]))).alias("pages"))


def cross_book_histogram(lookup: DataFrame) -> DataFrame:
    """(n_books, n_terms)."""
    return lookup.select("ord", "n_books").distinct().groupBy("n_books").agg(F.count("*").alias("n_terms"))


def main_term_counts(index: DataFrame) -> DataFrame:
    """For each book: terms, and main terms by either mark of a sub-entry."""
    return index.groupBy("book_key").agg(F.count("*").alias("n_terms"), F.count_if(~F.contains("term", F.lit(">"))).alias("n_main"), F.count_if(~F.contains("term", F.lit(" > "))).alias("n_main_spaced"))


def relations(lookup: DataFrame, pairs: DataFrame, books: DataFrame) -> dict[str, DataFrame]:
    """books, terms, occurrences and candidates; a term's id is its place in the lookup.

    Candidates are stored with the smaller id first; pairs with an unknown term go.
    """
    terms = lookup.select(F.col("ord").alias("id"), "term", "n_books").distinct()
    known = lambda n: terms.select(F.col("id").alias(f"id{n}"), F.col("term").alias(f"term{n}"))
    both = pairs.join(known(1), "term1").join(known(2), "term2")
    return {
        "books": books,
        "terms": terms,
        "occurrences": lookup.select(F.col("ord").alias("term_id"), "book_key", "pages"),
        "candidates": both.select(F.least("id1", "id2").alias("term1_id"), F.greatest("id1", "id2").alias("term2_id"), "match_type", "score"),
    }
