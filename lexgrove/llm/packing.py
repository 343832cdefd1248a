"""Packing token pieces into sequences by minimum bin slack.

1. One pass encodes every whole text, adds the separator, cuts only what is longer
   than a sequence, and writes one small row for each piece with its rank among its
   task's pieces of that length.  Ids and texts are not kept.
2. The histogram of piece lengths, at most `size` rows whatever the input, is
   packed on the driver.  For each bin the longest available length is taken, and a
   bitset subset-sum programme over the available lengths finds the fullest
   combination that fits beside it; the combination is removed as often as the
   counts allow.  That gives a plan of patterns, each with a run of sequences.
3. A piece finds its place from its length and its global rank among pieces of
   that length (task rank plus a prefix sum of the tasks' counts): no piece moves
   to another and no length is gathered in one task.

A null text is empty: it packs as the separator alone.  Rows with a null doc_id are
packed too.  Repeated rows are packed each.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .columns import small_batches
from .graph import durable
from .word_bpe import encoder

SEQUENCE, SEPARATOR = 2048, 0


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's rank among those of its length so far; seen is counted up."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.searchsorted(ordered, ordered, "left")
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = seen[ordered] + np.arange(len(lengths)) - first
    seen += np.bincount(lengths, minlength=len(seen))
    return ranks


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, separator: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    mark = np.array([separator], "<u4").tobytes()
    for batch in batches:
        for rows in K.slices(batch, "text"):
            ids, bounds = encoder(path).encode(rows.column("text"))
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            held = np.diff(bounds) + 1
            pieces = -(-held // size)
            row = np.repeat(np.arange(len(held)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(held[row] - start, size)
            last = start + length == held[row]
            begin = bounds[:-1][row] + start
            crc = [zlib.crc32(mark, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if z else zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n, z in zip(begin.tolist(), length.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(_ranks(length, seen))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )


def fullest(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """{length: how many} with the largest sum that fits in room; lengths descend, long ones are preferred.

    reach holds a bit for each sum that the lengths so far can make; a length that
    may be used several times is added in powers of two.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in zip(lengths, counts):
        left, times = min(count, room // length) if length <= room else 0, 1
        while left:
            use = min(times, left)
            steps.append((length, use, reach))
            reach |= (reach << (length * use)) & mask
            left -= use
            times *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, use, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + use
            total -= length * use
    return chosen


def plan(histogram: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, rank after the last, pieces in a sequence, first sequence, offset).

    The pieces of a length with ranks in a row's range lie in its run of sequences.
    """
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = next(iter(left))
        beside = [(k, v - (k == longest)) for k, v in left.items() if k <= size - longest]
        pattern = fullest([k for k, _ in beside], [v for _, v in beside], size - longest) if beside else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for k, n in sorted(pattern.items(), reverse=True):
            rows.append((k, used[k], used[k] + n * times, n, sequence, offset))
            offset += k * n
            used[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _places(batches: Iterator[pa.RecordBatch], rows: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    widest = int(rows[:, 2].max()) + 1 if len(rows) else 1  # ranks below 2**50 with lengths below 2**13 fit
    order = rows[:, 0] * widest + rows[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        row = rows[np.searchsorted(order, length * widest + rank, "right") - 1] if batch.num_rows else rows[:0]
        nth = rank - row[:, 1]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = durable(docs.mapInArrow(partial(_pieces, path=path, size=size, separator=separator), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long"))
    held = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before = held.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(partial(_places, rows=plan(histogram, size), size=size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
