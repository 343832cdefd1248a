"""Token counts from an exact length histogram.

`length_histogram` encodes every whole text and counts texts by encoded length;
counting happens inside each task, so a task sends at most one row for each
distinct length it saw.  `context_table` turns the histogram into suffix sums:
its row for a limit says how many texts and tokens lie at or above it and how many
tokens are left when every text is cut at it.  `at_limits` answers any limit and
`quantile` any share from that table, which has one row for each distinct length.

A null text is empty; an empty text has length 0 and is counted.  An empty table
gives empty tables.  Extra columns are ignored; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .columns import small_batches
from .word_bpe import encoder

#: Lengths are summed in ranges of this many first, then over the ranges.
SPAN = 128


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in batches:
        for part in K.slices(batch, "text"):
            for length, n in zip(*(x.tolist() for x in np.unique(encoder(path).lengths(part.column("text")), return_counts=True))):
                counts[length] = counts.get(length, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n_docs"])


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """(length, n_docs): how many texts have each encoded length, under the tokenizer file at path."""
    texts = small_batches(docs).select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial(_lengths, path=path), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: texts and tokens from it upwards, and what a cut at it leaves.

    Columns: context_limit, n_docs, docs_at_least, tokens_at_least, truncated_tokens
    (the sum of min(length, limit) over all texts), docs_at_most.
    """
    parts = histogram.withColumn("span", F.floor(F.col("length") / SPAN)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    spans = parts.groupBy("span").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "span",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("all_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(everything).alias("docs_total"),
        F.sum("all_tokens").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suffix = parts.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum("tokens").over(inside)).join(spans, "span")
    docs, tokens = F.col("docs_in") + F.col("docs_after"), F.col("tokens_in") + F.col("tokens_after")
    return suffix.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("tokens_total") - tokens + F.col("length") * docs).alias("truncated_tokens"),
        (F.col("docs_total") - docs + F.col("n_docs")).alias("docs_at_most"),
    )


def at_limits(table: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (context_limit) -> truncated_tokens for each, between the table's lengths too.

    A limit's row in the table is the smallest length at or above it; beyond the
    longest text nothing is cut, and the total stands.
    """
    longest = table.agg(F.max(F.struct("context_limit", "truncated_tokens")).alias("m")).select("m.truncated_tokens")
    asked = limits.select(F.col("context_limit").cast("long").alias("asked")).distinct()
    found = asked.join(table, F.col("asked") <= F.col("context_limit"), "left").groupBy("asked").agg(F.min(F.struct("context_limit", "truncated_tokens", "docs_at_least")).alias("r"))
    return found.crossJoin(F.broadcast(longest.withColumnRenamed("truncated_tokens", "total"))).select(
        F.col("asked").alias("context_limit"),
        F.when(F.col("r.context_limit").isNull(), F.col("total")).otherwise(F.col("r.truncated_tokens") - (F.col("r.context_limit") - F.col("asked")) * F.col("r.docs_at_least")).alias("truncated_tokens"),
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least that share of all texts do not exceed."""
    total = table.agg(F.max("docs_at_most").alias("total"))
    return table.join(F.broadcast(total)).where(F.col("docs_at_most") >= F.lit(share) * F.col("total")).agg(F.min("context_limit").alias("length"))
