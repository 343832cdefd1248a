"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score is a sum: its components are cut into `lists` runs, and each run gives
a partial score.  Every list is held apart, in cells of some ten thousand vectors.

1. Each cell of each list hands in its best partial scores for a query and its lowest
   one.  The vectors seen get their whole scores; the k-th best of these is a score that
   the answer reaches for certain.
2. That score, above the sum of the lists' lowest, is divided evenly among the lists:
   a vector that stays below its share in every list cannot be in the answer.  The cutoffs
   go to the cells with the queries, and cells hand in every entry at or above them.
3. With a list's cutoff as the bound of what is missing, entries are pruned once more;
   scores still incomplete are resolved exactly.

Queries meet vectors in blocks: a grid of shards of queries and cells of vectors, joined
on their place in the grid.  Equal vectors are one while searching, with their k + 1
smallest ids (more cannot be in an answer), and so are equal queries: a vector that a
third of all rows share is one row.  All arithmetic is on integers.

Rows without an id or vector, and vectors with a null or non-finite component, take no
part.  Repeated rows count once; of different vectors under one id the smallest counts.
Shorter vectors count as filled up with zeros.  An empty table, or one without queries,
gives no rows; fewer candidates than k give them all.  Extra columns are ignored.  Scores
that a long cannot hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import every
from .graph import durable

#: Vectors of a cell and queries of a shard, about; each pair of them is one group.
CELL, SHARD = 16384, 2048
#: Vectors multiplied at once.
STEP = 2048
#: Entries that a cell hands in for a query in the first phase.
SEEN = 64
#: Queries go to tasks whole where they need no more bytes than this.
BROADCAST_BYTES = 8 << 20


def quantised(df: DataFrame, ident: Column, vector: Column, scale: int) -> DataFrame:
    """(id, v): each usable vector's components as floor(scale * x)."""
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(ident.cast("long").alias("id"), vector.cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def _stacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def _partial_scores(table: pa.Table, width: int, kind: str):
    """The queries' rows and bounds, and for each step of vectors their rows and all partial scores."""
    asks = table.column("ask").to_numpy()
    queries, vectors = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    (q_rows, q), (v_rows, v) = ((part.column("row").to_numpy(), _stacked(part.column("v"), width).astype(kind)) for part in (queries, vectors))
    order = np.argsort(v_rows)
    steps = (order[a : a + STEP] for a in range(0, len(order), STEP))
    return q_rows, queries.column("bound").to_numpy(), ((v_rows[at], q @ v[at].T) for at in steps)


def _best(key: tuple, table: pa.Table, width: int, kind: str, most: int) -> pa.Table:
    """Each query's best entries of this cell and list, and the lowest partial score."""
    q_rows, _, steps = _partial_scores(table, width, kind)
    rows, scores, low = np.zeros((len(q_rows), 0), np.int64), np.zeros((len(q_rows), 0), kind), None
    for v_rows, got in steps:
        least = got.min(axis=1)
        low = least if low is None else np.minimum(low, least)
        rows = np.hstack([rows, np.broadcast_to(v_rows, got.shape)])
        scores = np.hstack([scores, got])
        if scores.shape[1] > most:
            top = np.argpartition(scores, scores.shape[1] - most, axis=1)[:, -most:]
            rows, scores = np.take_along_axis(rows, top, 1), np.take_along_axis(scores, top, 1)
    if low is None:
        low, q_rows = np.zeros(0, kind), q_rows[:0]
    n, wide = len(q_rows), scores.shape[1]
    parts = pa.array(np.arange(n + 1) * wide, pa.int32())
    return pa.table(
        {
            "query": pa.array(q_rows, pa.int64()),
            "list": pa.array(np.full(n, key[0].as_py()), pa.int32()),
            "low": pa.array(low.astype(np.int64), pa.int64()),
            "rows": pa.ListArray.from_arrays(parts, pa.array(rows.ravel(), pa.int64())),
            "scores": pa.ListArray.from_arrays(parts, pa.array(scores.ravel().astype(np.int64), pa.int64())),
        }
    )


def _above(key: tuple, table: pa.Table, width: int, kind: str) -> pa.Table:
    """Every entry of this cell and list that reaches its query's cutoff, with what it adds to what is missing.

    over is the score above the most that a missing entry has, lift that above the least.
    """
    q_rows, bounds, steps = _partial_scores(table, width, kind)
    lows = table.filter(table.column("ask")).column("low").to_numpy()
    found = [(np.zeros(0, np.int64),) * 5]
    for v_rows, got in steps:
        q, v = np.nonzero(got >= bounds[:, None].astype(kind))
        score = got[q, v].astype(np.int64)
        found.append((q_rows[q], v_rows[v], score, score - bounds[q] + 1, score - lows[q]))
    return pa.table(dict(zip(("query", "row", "score", "over", "lift"), (np.concatenate(x) for x in zip(*found)))))


def _products(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, v = (batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(kind) for name in ("q", "v"))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("row"), pa.array(np.einsum("ij,ij->i", q, v).astype(np.int64))], ["query", "row", "score"])


class _Grid:
    """Queries and vectors list by list, in shards and cells."""

    def __init__(self, vectors: DataFrame, width: int, lists: int, kind: str, shape: tuple[int, int]):
        self.vectors, self.lists, self.kind, (self.shards, self.cells) = vectors, lists, kind, shape
        self.width = width // lists

    def _runs(self, df: DataFrame, *more: Column) -> DataFrame:
        run = lambda j: F.slice("v", j * self.width + 1, self.width)
        lists = F.array(*[F.struct(F.lit(j).alias("list"), run(j).alias("v"), *[c.getItem(j).alias(f"more{n}") for n, c in enumerate(more)]) for j in range(self.lists)])
        return df.select("row", F.explode(lists).alias("l")).select("row", "l.*")

    def rows(self, queries: DataFrame, bounds: Column, lows: Column) -> DataFrame:
        """queries (row, v) with arrays of a bound and a lowest score for each list, beside the vectors that they meet."""
        place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        number = lambda c, name: c.cast("long").alias(name)
        asks = self._runs(queries, bounds, lows).select("list", place(self.shards).alias("shard"), everywhere(self.cells).alias("cell"), F.lit(True).alias("ask"), "row", "v", number(F.col("more0"), "bound"), number(F.col("more1"), "low"))
        held = self._runs(self.vectors).select("list", everywhere(self.shards).alias("shard"), place(self.cells).alias("cell"), F.lit(False).alias("ask"), "row", "v", number(F.lit(0), "bound"), number(F.lit(0), "low"))
        return asks.union(held)

    def run(self, rows: DataFrame, work, schema: str) -> DataFrame:
        # applyInArrow counts the arguments of what it is given
        call = partial(work, width=self.width, kind=self.kind)
        return rows.groupBy("list", "shard", "cell").applyInArrow(lambda key, table: call(key, table), schema)


def _whole_scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, width: int, kind: str, small: bool) -> DataFrame:
    """(query, row, score): the exact scores of pairs (query, row)."""
    asks = queries.select(F.col("row").alias("query"), F.col("v").alias("q"))
    joined = pairs.join(vectors.select("row", "v"), "row").join(F.broadcast(asks) if small else asks, "query")
    return joined.select("query", "row", "q", "v").mapInArrow(partial(_products, width=width, kind=kind), "query long, row long, score long")


def _first(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def search(df: DataFrame, asks: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding", scale: int = 256, lists: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows; ties go to the smaller id.

    asks tells from the column `id` whether a row is a query.
    """
    whole = quantised(df, every([ident])[0], every([vector])[0], scale)
    large = F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))
    seen = whole.agg(F.count("*").alias("n"), F.coalesce(F.count_if(asks), F.lit(0)).alias("queries"), F.max(F.size("v")).alias("width"), large.alias("large")).first()
    width, large = max(lists, seen["width"] or 0), int(seen["large"] or 0)
    width += -width % lists
    if width * large**2 >= 2**63:
        raise ValueError(f"scores of {width} components up to {large} do not fit a long")
    kind = "float32" if width * large**2 < 2**24 else "float64" if width * large**2 < 2**53 else "int64"
    stored = "smallint" if large < 2**15 else "int" if large < 2**31 else "bigint"
    shape = -(-max(1, seen["queries"]) // SHARD), -(-max(1, seen["n"]) // CELL)

    # one vector for each id, then one row for each vector with its smallest ids
    one = durable(whole.groupBy("id").agg(F.min("v").alias("v")).select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).cast(f"array<{stored}>").alias("v")))
    least = _first(one, ["v"], [F.col("id")], k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = durable(least.select(F.get("ids", F.lit(0)).alias("row"), "v", "ids"))
    owners = durable(one.where(asks).join(vectors.select("row", "v"), "v").select(F.col("id").alias("query_id"), F.col("row").alias("query")))
    queries = durable(vectors.join(owners.select(F.col("query").alias("row")).distinct(), "row", "left_semi").select("row", "v"))
    small = seen["queries"] * (width * 8 + 64) <= BROADCAST_BYTES
    grid, deep = _Grid(vectors, width, lists, kind, shape), k + 1

    # phase 1: local lists, and the cutoffs they allow
    none = F.array(*[F.lit(0)] * lists)
    local = durable(grid.run(grid.rows(queries, none, none), partial(_best, most=max(SEEN, deep)), "query long, list int, low long, rows array<long>, scores array<long>"))
    entries = local.select("query", "list", F.explode(F.arrays_zip("rows", "scores")).alias("e")).select("query", "list", F.col("e.rows").alias("row"), F.col("e.scores").alias("part"))
    known = _first(entries, ["query", "list"], [F.desc("part"), F.col("row")], max(SEEN, deep)).select("query", "row").distinct()
    sure = _first(_whole_scores(known, queries, vectors, width, kind, small), ["query"], [F.desc("score"), F.col("row")], deep).groupBy("query").agg(F.when(F.count("*") == deep, F.min("score")).alias("sure"))
    lows = local.groupBy("query", "list").agg(F.min("low").alias("low")).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "low"))), lambda e: e["low"]).alias("lows"))
    total = F.aggregate("lows", F.lit(0).cast("long"), lambda s, x: s + x)
    share = F.when(F.col("sure").isNull(), F.lit(0)).otherwise(F.expr(f"(sure - total + {lists - 1}) div {lists}"))
    limits = durable(lows.join(sure, "query", "left").withColumn("total", total).withColumn("share", share).select("query", "sure", "total", "lows", F.transform("lows", lambda x: x + F.col("share")).alias("cutoffs")))

    # phase 2: all entries at or above the cutoffs
    asked = queries.join(limits.select(F.col("query").alias("row"), "cutoffs", "lows"), "row")
    sent = grid.run(grid.rows(asked, F.col("cutoffs"), F.col("lows")), _above, "query long, row long, score long, over long, lift long")
    gathered = sent.groupBy("query", "row").agg(F.sum("score").alias("part"), F.sum("over").alias("over"), F.sum("lift").alias("lift"), (F.count("*") == lists).alias("whole"))
    most = F.aggregate("cutoffs", F.lit(0).cast("long"), lambda s, x: s + x - 1)
    totals = limits.select("query", "sure", F.col("total").alias("least"), most.alias("most"))
    bounded = durable(gathered.join(F.broadcast(totals) if small else totals, "query").select("query", "row", "part", "sure", "whole", (F.col("over") + F.col("most")).alias("upper"), (F.col("lift") + F.col("least")).alias("lower")))

    # phase 3: what can still reach the answer is resolved
    second = _first(bounded, ["query"], [F.desc("lower"), F.col("row")], deep).groupBy("query").agg(F.when(F.count("*") == deep, F.min("lower")).alias("second"))
    left = bounded.join(F.broadcast(second) if small else second, "query").where("upper >= coalesce(greatest(sure, second), upper)")
    full = left.where("whole").select("query", "row", F.col("part").alias("score"))
    rest = _whole_scores(left.where("NOT whole").select("query", "row"), queries, vectors, width, kind, small)
    # a row is its vector's smallest id, so k + 1 rows by score and then row hold the k + 1 first ids
    best = _first(full.union(rest), ["query"], [F.desc("score"), F.col("row")], deep)
    named = best.join(vectors.select("row", "ids"), "row").select("query", "score", F.explode("ids").alias("vec_id"))
    ranks = named.join(owners, "query").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id")))
    return ranks.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
