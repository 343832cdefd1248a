"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable

#: Texts of more bytes are left out of a sample (never out of what a model is applied to).
LONGEST = 1 << 20
#: Most bytes of texts of a sample that come to the driver.
SAMPLE_BYTES = 48 << 20
#: Most distinct label values.
VALUES = 1000


def short_enough(text: str = "text"):
    """Texts that may be in a sample."""
    return F.col(text).isNotNull() & (F.octet_length(text) <= LONGEST)


def balanced(rows: DataFrame, label: str, each: int, key: str = "doc_id", made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """About `each` rows of every label value, chosen by a hash of the key; at most 2 * each * values come back.

    One pass counts the labels (a row for each value, VALUES at most), a second keeps
    the rows whose hash falls below their value's share.  The choice is the same
    whatever the partitioning.  made turns the chosen rows into smaller ones with the same
    key and label before they are put in order.  No labelled row at all gives an empty sample.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count("*").alias("held")).limit(VALUES + 1).collect()
    if len(counts) > VALUES:
        raise ValueError(f"{label} has more than {VALUES} values")
    if not counts:
        return rows.limit(0) if made is None else made(rows.limit(0))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(1.0, each / r.held))])
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(place <= F.element_at(share, F.col(label)))
    chosen = chosen if made is None else made(chosen)
    return chosen.orderBy(place, *[F.xxhash64(c) for c in chosen.columns]).limit(2 * each * len(counts))


def labelled_texts(docs: DataFrame, chosen: list, label: str) -> tuple[pa.Array, list]:
    """(texts, labels) of the chosen rows (doc_id, label), in the order of ids, up to SAMPLE_BYTES in all.

    Only the chosen ids go to the tasks.  Of each id one text stays, the shortest of several.
    The sample, one row for each id at most, is written once; its sizes come to the driver
    first, and then the texts that the bound has room for (ids in the order of their hash,
    the same whatever the partitioning).
    """
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r[label]) for r in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(short_enough()).join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id")
    one = durable(texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text")))
    sizes = one.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("place")).collect()
    held, kept = 0, []
    for r in sorted(sizes, key=lambda r: r.place):
        held += r.n
        if held > SAMPLE_BYTES:
            break
        kept.append((r.doc_id,))
    if len(kept) < len(sizes):
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame(kept, ids.select("doc_id").schema)), "doc_id", "left_semi")
    got = one.select("doc_id", "label", "text").toArrow().sort_by("doc_id")
    return pa.chunked_array(got["text"].chunks, pa.string()).combine_chunks() if got.num_rows else pa.array([], pa.string()), got["label"].to_pylist()
