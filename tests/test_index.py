"""Index lines: pages, terms, continuations, sub-entries, where an index begins."""

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import index


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize("line, pages", [("term, 1, 23f, 100–105, 200b", ["1", "23f", "100–105", "200b"]), ("ISBN 12345", []), ("none", [])])
def test_extract_pages(spark, line, pages):
    assert one(spark, T.extract_pages(F.lit(line))) == pages


@pytest.mark.parametrize("term, want", [("working memory, see also long-term memory", "working memory"), ("EEG (electroencephalogram)", "EEG (electroencephalogram)"), ("term,;. ", "term"), ("oversee", "over")])
def test_normalize_term(spark, term, want):
    assert one(spark, T.normalize_term(F.lit(term))) == want


def lines(spark, *raw):
    return spark.createDataFrame([("b", i, r) for i, r in enumerate(raw)], "book_key string, line_no int, raw string")


def parsed(spark, raw, strategy="capitalize"):
    return {r.term: r.pages for r in index.parse_index(lines(spark, *raw), strategy).collect()}


@pytest.mark.parametrize("raw, n", [(["Term, 12, 34,\n", "56, 78\n"], 1), (["Brain-computer interface,\n", "invasive methods, 45\n"], 1), (["Amygdala, 1\n", "\n", "Brain, 2\n"], 3), (["A term\n", "lower, 3\n"], 2)])
def test_join_continuations(spark, raw, n):
    rows = index.join_continuations(lines(spark, *raw)).orderBy("line_no").collect()
    assert len(rows) == n
    if n == 1:
        assert rows[0].line == " ".join(x.strip() for x in raw)


def test_sub_entries(spark):
    assert parsed(spark, ["Hippocampus", "in memory formation, 12"]) == {"Hippocampus": [], "Hippocampus > in memory formation": ["12"]}
    for strategy in ("capitalize", "indent_only"):
        assert parsed(spark, ["Cortex, 10", "  visual, 20"], strategy) == {"Cortex": ["10"], "Cortex > visual": ["20"]}
    assert parsed(spark, ["cortex, 10", "visual, 20"], "indent_only") == {"cortex": ["10"], "visual": ["20"]}


def test_duplicate_pages_stay_and_skips_go(spark):
    assert parsed(spark, ["Index", "A", "Term, 10, 10", "See also", "X, 5"]) == {"Term": ["10", "10"]}


def test_index_start(spark):
    raw = ["text"] * 70 + ["Index", "", "Amygdala, 12"] + ["Brain, 3"] * 5
    assert index.index_start(lines(spark, *raw)).first().start_line == 73
    assert index.index_start(lines(spark, *(["text"] * 70 + ["Brain, 3"]))).first().start_line == 71
    assert index.index_start(lines(spark, *(["text"] * 10))).count() == 0
