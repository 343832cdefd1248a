"""Benchmark decontamination by greedy string tiling.

A document is compared with the benchmark items that share seeds with it: runs of
`tile` words, the shortest that count, which cover at least `coverage` of the item
before they are laid out as tiles; what tiles cover is never more.  The words both
have are tiled: the longest run of unmarked words
common to both is found by window hashes of any length with a binary search over its
length, marked in both, and so on while runs of `tile` words or more are left.  The
share of the item's words under tiles is its coverage, whatever the order of the
runs in the document, so shuffled passages are found too.

The benchmark is the stated query set.  It is read in blocks bounded by
`block_bytes` of text; each block's seeds go to the tasks and all documents are
scanned against it, so its size bounds memory, not which items count.  Documents
are scanned where they lie: nothing is shuffled.

Words are runs of letters and digits of any script, lower-cased; a script written
without spaces has a word for each letter.  An item of fewer than `tile`
words is one seed whole.  Items without words, null items and null or empty texts match
nothing.  Items with equal words are tiled once and all reported.  Repeated rows
are each reported; ids may be null.  An empty side gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .columns import numbered_names, small_batches

TILE_WORDS, COVERAGE = 3, 0.5
BLOCK_BYTES = 8 << 20
#: About so many places of items are compared with texts at once.
PLACES = 1 << 20

#: Letters and digits by bytes; those beyond ASCII are letters, once `spaced` has seen to what is none.
WORD_TABLE = np.zeros(256, np.uint8)
WORD_TABLE[48:58] = WORD_TABLE[65:91] = WORD_TABLE[97:123] = WORD_TABLE[128:] = 1


# What is no letter, mark or digit; letters of scripts that are written without spaces.
_OTHER = r"[^\p{L}\p{M}\p{N}]+"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
#: Lead bytes of code points that are letters of alphabets with spaces, but for two signs: Latin from U+00C0 on, Cyrillic.
_PLAIN = np.zeros(256, bool)
_PLAIN[:0xC0] = True
_PLAIN[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xD0, 0xD1]] = True


def spaced(column: pa.Array) -> pa.Array:
    """Lower-cased texts with words set apart: signs beyond ASCII are spaces, each letter of an unspaced script is a word.

    Texts without such code points, which their lead bytes tell, are only lower-cased.
    """
    column = pc.utf8_lower(column)
    data, offsets = K.buffer_of(column)
    odd = ~_PLAIN[data]
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of multiplication and division
    odd = np.append(0, np.cumsum(odd))[offsets]
    mask = pa.array(np.diff(odd) > 0)
    if not pc.any(mask).as_py():
        return column
    texts = pc.replace_substring_regex(pc.fill_null(column.filter(mask), ""), pattern=_OTHER, replacement=" ")
    return pc.replace_with_mask(column, mask, pc.replace_substring_regex(texts, pattern=_UNSPACED, replacement=r" \1 "))


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words) of each tile, longest first, earliest place first among equals.

    A place where text holds 0 is a gap that no run crosses.
    """
    free_item, free_text = np.ones(len(item), bool), text != 0
    runs_item, runs_text = K.Runs(item), K.Runs(text)
    found = []

    def starts(free: np.ndarray, s: int) -> np.ndarray:
        sums = np.append(0, np.cumsum(free))
        return np.flatnonzero(sums[s:] - sums[:-s] == s)

    def match(s: int):
        i, j = starts(free_item, s), starts(free_text, s)
        if not len(i) or not len(j):
            return None
        a, b = runs_item.windows(s)[i], runs_text.windows(s)[j]
        hit = np.flatnonzero(np.isin(a, b))
        return (int(i[hit[0]]), int(j[np.flatnonzero(b == a[hit[0]])[0]])) if len(hit) else None

    high = min(len(item), len(text))
    while len(item) >= least:
        low, best = least, match(least)
        if best is None:
            return found
        while low < high:
            middle = (low + high + 1) // 2
            at = match(middle)
            if at is None:
                high = middle - 1
            else:
                low, best = middle, at
        i, j = best
        free_item[i : i + low] = False
        free_text[j : j + low] = False
        found.append((i, j, low))
        high = low  # no later tile is longer
    return found


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, place below counts[n]) for each n as often as counts says."""
    n = np.repeat(np.arange(len(counts)), counts)
    return n, np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)


class Seeds:
    """Seeds of the items that have seeds of one size: sorted hashes, the items that have each, and where."""

    def __init__(self, words: list[tuple[int, np.ndarray]], size: int):
        each = [K.windows(w, size) for _, w in words]
        hashes = np.concatenate(each)
        items = np.repeat(np.array([n for n, _ in words], np.int64), [len(h) for h in each])
        places = np.concatenate([np.arange(len(h)) for h in each])
        order = np.lexsort((places, items, hashes))
        hashes, items, self.places = hashes[order], items[order], places[order]
        new_hash = np.append(True, hashes[1:] != hashes[:-1])
        new = np.append(True, new_hash[1:] | (items[1:] != items[:-1]))
        self.size, self.hashes = size, hashes[new_hash]
        self.first_place = np.append(np.flatnonzero(new), len(hashes))  # of each seed and item
        self.items = items[new]
        self.first = np.append(np.flatnonzero(new_hash[new]), len(self.items))  # item of each seed
        self.cost = np.diff(self.first_place[self.first])
        self.table = np.zeros(1 << 20, bool)  # most windows of a text fail here at once
        self.table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(text, seed) for each seed in each text, once, in order."""
        hashes = K.windows(words.hashes, self.size)
        at = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        held = self.hashes[seed] == hashes[at]
        at, seed = at[held], seed[held]
        row = np.searchsorted(words.bounds, at, "right") - 1
        inside = at + self.size <= words.bounds[row + 1]
        both = np.unique(row[inside] * len(self.hashes) + seed[inside])
        return both // len(self.hashes), both % len(self.hashes)

    def near(self, words: K.Tokens, need: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) where the seeds of a text cover as many words of the item as it needs."""
        row, seed = self.hits(words)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        before = np.append(0, np.cumsum(self.cost[seed]))
        a = 0
        while a < len(starts):  # whole texts, of which the places are few enough
            b = max(a + 1, int(np.searchsorted(before[starts], before[starts[a]] + PLACES, "left")))
            low, high = starts[a], starts[b] if b < len(starts) else len(row)
            a = b
            n, k = _spread(np.diff(self.first)[seed[low:high]])
            entry = self.first[seed[low:high]][n] + k
            m, k = _spread(np.diff(self.first_place)[entry])
            place = self.places[self.first_place[entry][m] + k]
            text, item = row[low:high][n][m], self.items[entry][m]
            order = np.lexsort((place, item, text))
            text, item, place = text[order], item[order], place[order]
            new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
            covered = np.full(len(place), self.size)
            covered[1:] = np.where(new[1:], self.size, np.minimum(self.size, np.diff(place)))
            first = np.flatnonzero(new)
            enough = np.add.reduceat(covered, first) >= need[item[first]]
            yield from zip(text[first][enough].tolist(), item[first][enough].tolist())


class Index:
    """Seeds of one block of items by their size."""

    def __init__(self, items: list[tuple[object, str]], tile: int):
        data, offsets = K.buffer_of(spaced(pa.array([text for _, text in items], pa.large_string())))
        words = K.tokenize(data, offsets, WORD_TABLE)
        same: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.ids: list[list] = []
        for (name, _), a, b in zip(items, words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            if a == b:
                continue
            own = words.hashes[a:b]
            at = same.setdefault(own.tobytes(), len(same))
            if at == len(self.words):
                self.words.append(own.copy())
                self.ids.append([])
            self.ids[at].append(name)
        short = [min(tile, len(w)) for w in self.words]
        self.seeds = [Seeds([(n, w) for n, w in enumerate(self.words) if short[n] == size], size) for size in sorted(set(short))]


def _found(column: pa.Array, index: Index, need: np.ndarray, coverage: float) -> Iterator[tuple]:
    """(row, item, share, tiles, longest) of the items that leak into the texts of a column."""
    words = K.tokenize(*K.buffer_of(spaced(column)), WORD_TABLE)
    for seeds in index.seeds:
        for row, item in seeds.near(words, need):
            own = index.words[item]
            least = seeds.size
            whole = words.hashes[words.bounds[row] : words.bounds[row + 1]]
            shared = np.flatnonzero(np.isin(K.windows(whole, least), K.windows(own, least)))
            places = np.unique((shared[:, None] + np.arange(least)).ravel())
            gap = np.flatnonzero(np.diff(places) > 1) + 1
            found = tiles(own, np.insert(whole[places], gap, np.uint64(0)), least)
            share = sum(n for _, _, n in found) / len(own)
            if found and share >= coverage - 1e-9:
                yield row, item, share, len(found), max(n for _, _, n in found)


def _scan(batches: Iterator[pa.RecordBatch], index, kinds: list[pa.DataType], coverage: float) -> Iterator[pa.RecordBatch]:
    index = index.value if hasattr(index, "value") else index
    need = np.array([len(w) for w in index.words]) * (coverage - 1e-9)
    for batch in batches:
        for part in K.slices(batch, "text"):
            out = [(row, name, *more) for row, item, *more in _found(part.column("text"), index, need, coverage) for name in index.ids[item]]
            rows, names, shares, counts, longest = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, kinds[1]), pa.array(shares, pa.float64()), pa.array(counts, pa.int32()), pa.array(longest, pa.int32())],
                ["doc_id", "item_id", "coverage", "n_tiles", "longest"],
            )


def _clean(batches: Iterator[pa.RecordBatch], index, at: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """The rows into whose text, the column at that place, no item leaks."""
    index = index.value if hasattr(index, "value") else index
    need = np.array([len(w) for w in index.words]) * (coverage - 1e-9)
    for batch in batches:
        for part in K.slices(batch, at):
            keep = np.ones(part.num_rows, bool)
            for row, *_ in _found(part.column(at), index, need, coverage):
                keep[row] = False
            yield part if keep.all() else part.filter(pa.array(keep))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each document and item with at least that coverage."""
    docs = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(benchmark.schema["item_id"].dataType)]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, coverage double, n_tiles int, longest int"
    found = None
    for block in _blocks(benchmark, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, tile))
        part = docs.mapInArrow(partial(_scan, index=index, kinds=kinds, coverage=coverage), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no item leaks into, with all their columns, whatever their doc_id.

    Rows are dropped where they are scanned: nothing is shuffled, and each row stands for
    itself, so null and repeated ids need no care.
    """
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    at = docs.columns.index("text")
    rows = numbered_names(small_batches(docs))
    if dict(docs.dtypes)["text"] != "string":
        rows, at = rows.withColumn("text", F.col(f"c{at}").cast("string")), len(docs.columns)
    for block in _blocks(benchmark, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, tile))
        rows = rows.mapInArrow(partial(_clean, index=index, at=at, coverage=coverage), rows.schema)
    return rows.select(*[f"c{n}" for n in range(len(docs.columns))]).toDF(*docs.columns)
