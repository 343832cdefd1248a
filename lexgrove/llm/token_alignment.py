"""Cross-tokenizer alignment by elementary intervals.

A text's bytes are covered twice, by the tokens of a byte-level BPE (A) and by those of
a piece model (B).  The union of both tokenizers' ends cuts the bytes into elementary
intervals; searchsorted finds the A and the B token that own each one, so every interval
is one overlap.  Ends that both share close a group; within a group every A token is
linked to every B token.

Neither tokenizer joins anything across a space that follows a visible character, so
both end there: the alignment of a text is that of its words one after another.  Each
distinct word is encoded and aligned once for as long as a worker remembers it, and a
text is put together from its words, in pieces of about a megabyte however long it is.

A link's count is the number of documents that hold its pair of ids linked.  Documents
are written once with their distinct pairs; counts come from them with partial sums in
each task and go back to the documents as a broadcast while they are few, else by a join.

A text that is null, empty, or that the joined tokens of either side do not spell has no
tokens: its counts are 0, its digest is ''.  Every row is a document, repeated ones too.
An empty table gives no rows.  Kept columns keep their names; others are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .columns import every, fresh, small_batches
from .graph import shared_folder

#: Distinct words that a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 256
#: Distinct pairs of ids whose counts go to all tasks; beyond, pairs are joined with their counts.
BROADCAST_PAIRS = 1 << 20
#: Words encoded in one call, and words learnt at once.
TOGETHER, LEARNT = 500, 32_000

SPACE, MARK = b" ", "▁"
# How a byte-level tokenizer cuts text before merging, and the characters below U+0250 that are plain letters or printable ASCII.
_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile(rb"(?:[ -~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def level_bytes(token: str) -> bytes:
    """The bytes of a byte-level token: printable Latin-1 stands for itself, the other bytes for U+0100 and on."""
    return bytes(_LEVEL[c] for c in token)


def _level() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


_LEVEL = _level()


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a space, <0xHH> the byte HH."""
    byte = _BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()


class Pair:
    """Two tokenizers that encode words, each beginning with a space."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        words = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [w.encode() if i in special else level_bytes(w) for i, w in enumerate(words)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.plain = self._plain(byte_level, special)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def _plain(self, path: str, special: set[int]):
        """The same merges in a faster library, for texts of characters that need no character database."""
        import json

        import tiktoken

        with open(path) as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [bytes([b]) for b in range(256)] + [level_bytes(x + y) for x, y in pairs]
        ids = {level_bytes(w): i for w, i in model["vocab"].items() if i not in special}
        ranks = {w: n for n, w in enumerate(dict.fromkeys(order))}
        to_id = [ids[w] for w in ranks]
        own = tiktoken.Encoding("byte level", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

        class Plain:
            @staticmethod
            def encode_ordinary(text: str) -> list[int]:
                return [to_id[n] for n in own.encode_ordinary(text)]

        return Plain

    def _flat(self, words: list[bytes], encode, spelt: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has; -1 where they do not spell it).

        Words that end visibly are encoded together and told apart by their bytes.
        """
        counts, ids = np.full(len(words), -1, np.int64), [np.zeros(0, np.int64)] * len(words)
        visible = [_visible_end(w) for w in words]
        alone, joined = ([n for n, v in enumerate(visible) if v == which] for which in (False, True))
        groups = [joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
        texts = [b"".join([words[n] for n in g]) for g in groups]
        for group, text, got in zip(groups, texts, encode([t.decode() for t in texts])):
            got = np.array(got, np.int64)
            ends, stops = np.cumsum(sizes[got]), np.cumsum([len(words[n]) for n in group])
            at = np.searchsorted(ends, stops)
            if b"".join([spelt[i] for i in got.tolist()]) != text or (ends[np.minimum(at, len(ends) - 1)] != stops).any():
                alone += group
                continue
            counts[group] = np.diff(at, prepend=-1)
            ids[group[0]] = got  # in the place of the first; the words of a group come in order
        for n, got in zip(alone, encode([words[n].decode() for n in alone])):
            if b"".join([spelt[i] for i in got]) == words[n]:
                counts[n], ids[n] = len(got), np.array(got, np.int64)
        return ids, counts

    def encode(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the words in an order of their own; A ids and their number, B ids and their number)."""
        words = sorted(words, key=lambda w: (_visible_end(w), _PLAIN.fullmatch(w) is not None), reverse=True)
        space = self.b.piece_to_id(MARK)
        by_a = lambda texts: [self.plain.encode_ordinary(t) if _PLAIN.fullmatch(t.encode()) else self.a.encode(t, add_special_tokens=False).ids for t in texts]
        by_b = lambda texts: [[space] if t == " " else x for t, x in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1))]  # noqa: E731  its own space comes first
        (a, n_a), (b, n_b) = self._flat(words, by_a, self.a_bytes, self.a_sizes), self._flat(words, by_b, self.b_bytes, self.b_sizes)
        return words, np.concatenate(a), n_a, np.concatenate(b), n_b


def _visible_end(word: bytes) -> bool:
    return 32 < word[-1] < 127 or (word[-1] >= 128 and 0xC3 <= word[-2] <= 0xDF)


class Aligned:
    """The alignment of a run of bytes that both token lists spell: groups and links."""

    __slots__ = ("ends", "shared", "n_links", "links", "a_group", "b_group")

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        self.ends = np.union1d(a_ends, b_ends)  # of the elementary intervals
        a_owner, b_owner = np.searchsorted(a_ends, self.ends), np.searchsorted(b_ends, self.ends)
        self.shared = (a_ends[a_owner] == self.ends) & (b_ends[b_owner] == self.ends)
        group = np.cumsum(self.shared) - self.shared  # of each interval
        self.a_group, self.b_group = np.zeros(len(a_ends), np.int64), np.zeros(len(b_ends), np.int64)
        self.a_group[a_owner], self.b_group[b_owner] = group, group
        n = int(self.shared.sum())
        n_a, n_b = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        self.n_links = n_a * n_b
        # group products: each A token beside all B tokens of its group
        times = n_b[self.a_group]
        first_b = np.cumsum(n_b) - n_b
        a_at = np.repeat(np.arange(len(a_ends)), times)
        b_at = np.repeat(first_b[self.a_group], times) + np.arange(len(a_at)) - np.repeat(np.cumsum(times) - times, times)
        self.links = a_at, b_at


def _digests(a: np.ndarray, b: np.ndarray, both: Aligned, stops: np.ndarray, spelt: list[bytes], sizes: np.ndarray) -> list[bytes]:
    """a1,a2|b1;a3|b2 of each word; stops: how many groups lie in it and before it.

    spelt has an id's digits with a comma, a bar and a semicolon behind them.
    """
    last = lambda group: np.append(np.diff(group) > 0, True)
    ids = np.concatenate([3 * a + last(both.a_group), 3 * b + 2 * last(both.b_group)])
    group = np.concatenate([both.a_group, both.b_group])
    order = np.argsort(2 * group + (np.arange(len(ids)) >= len(a)), kind="stable")
    ids, group = ids[order], group[order]
    text = b"".join(map(spelt.__getitem__, ids.tolist()))
    ends = np.append(0, np.cumsum(sizes[ids]))[np.searchsorted(group, stops)].tolist()
    return [text[x : y - 1] for x, y in zip([0, *ends[:-1]], ends)]


class Words:
    """What is known of words: numbers of tokens, groups and links, digests, pairs with their multiplicity."""

    def __init__(self, pair: Pair):
        self.pair, self.base = pair, len(pair.b_bytes)
        self.spelt = [b"%d%c" % (n, c) for n in range(max(len(pair.a_bytes), self.base)) for c in b",|;"]
        self.sizes = np.array([len(x) for x in self.spelt], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.digests: list[bytes] = []
        #: Columns: A tokens, B tokens, groups, links, whether the tokens spell it not.
        self.numbers, self.counts, self.used = np.zeros((0, 5), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Each word's place; new ones are encoded and aligned."""
        new = [w for w in words if w not in self.known]
        for k in range(0, len(new), LEARNT):
            self._learn(new[k : k + LEARNT])
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.used[place] += 1
        return place

    def _learn(self, new: list[bytes]) -> None:
        new, a, n_a, b, n_b = self.pair.encode(new)
        fine = np.flatnonzero((n_a >= 0) & (n_b >= 0))
        at = lambda n: np.repeat(np.arange(len(new)), np.maximum(n, 0))
        usable = (n_a >= 0) & (n_b >= 0)
        a, b, n_a, n_b = a[usable[at(n_a)]], b[usable[at(n_b)]], n_a[fine], n_b[fine]
        numbers, counts, digests = np.zeros((len(new), 5), np.int32), np.zeros(len(new), np.int64), [b""] * len(new)
        numbers[:, 4] = 1
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(fine):
            both = Aligned(self.pair.a_sizes[a], self.pair.b_sizes[b])
            # both end where a word ends, so each group lies in one word
            word = np.repeat(np.arange(len(fine)), n_a)
            of_group = np.zeros(len(both.n_links), np.int64)
            of_group[both.a_group] = word
            groups = np.bincount(of_group, minlength=len(fine))
            links = np.bincount(of_group, both.n_links, len(fine)).astype(np.int64)
            numbers[fine] = np.stack([n_a, n_b, groups, links, np.zeros(len(fine), np.int64)], 1)
            a_at, b_at = both.links
            owner, pairs = word[a_at], a[a_at] * self.base + b[b_at]
            order = np.lexsort((pairs, owner))
            owner, pairs = owner[order], pairs[order]
            first = np.flatnonzero(np.append(True, (np.diff(owner) > 0) | (np.diff(pairs) > 0)))
            times = np.diff(np.append(first, len(pairs)))
            pairs = pairs[first]
            counts[fine] = np.bincount(owner[first], minlength=len(fine))
            for n, text in zip(fine.tolist(), _digests(a, b, both, np.cumsum(groups), self.spelt, self.sizes)):
                digests[n] = text
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.digests += digests
        self.numbers, self.counts, self.used = np.vstack([self.numbers, numbers]), np.append(self.counts, counts), np.append(self.used, np.zeros(len(new), np.int64))
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times.astype(np.int32))
        self.starts = np.cumsum(self.counts) - self.counts

    def settle(self) -> None:
        """Between slices: where words or their digests have become too many, the shorter ones seen again stay, half at most."""
        if len(self.known) <= REMEMBERED and sum(map(len, self.digests[-TOGETHER:])) <= TOGETHER * 4 * LONGEST:
            return
        words = list(self.known)
        short = np.array([len(w) <= LONGEST for w in words], bool)
        stay = np.flatnonzero(short & (self.used > 1))
        if len(stay) > REMEMBERED // 2:
            stay = np.sort(stay[np.argsort(self.used[stay])[-(REMEMBERED // 2) :]])
        size = self.counts[stay]
        at = np.repeat(self.starts[stay] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.pairs, self.times = self.pairs[at], self.times[at]
        self.numbers, self.counts, self.used = self.numbers[stay], size, self.used[stay] // 2
        self.starts = np.cumsum(size) - size
        self.digests = [self.digests[n] for n in stay.tolist()]
        self.known = {words[n]: k for k, n in enumerate(stay.tolist())}


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin: at each text's start, and at a space behind what ends a visible character for certain."""
    space = np.flatnonzero(data == 32)
    space = space[space >= 3]
    one, two, three = data[space - 1], data[space - 2], data[space - 3]
    plain = (one > 32) & (one < 127)
    # two bytes: no white space from 0xC3 on; three bytes: none but below 0xE1 to 0xE3
    pair = (one >= 128) & (two >= 0xC3) & (two <= 0xDF)
    triple = (one >= 128) & (two >= 128) & (two < 0xC0) & ((three == 0xE0) | ((three >= 0xE4) & (three <= 0xEF)))
    mark = np.zeros(len(data), bool)
    mark[space[plain | pair | triple]] = True
    mark[starts] = True
    return np.flatnonzero(mark)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(where words begin, where they end, their texts) for runs of about a megabyte."""
    lo, size = 0, len(data)
    starts = offsets[:-1][np.diff(offsets) > 0]
    while lo < size:
        hi = min(size, lo + K.PIECE)
        while True:
            inner = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
            cuts = lo + _cuts(data[lo:hi], np.append(0, inner - lo))
            if hi == size:
                stop = size
                break
            if len(cuts) > 1:  # the last word may go on
                stop = int(cuts[-1])
                cuts = cuts[:-1]
                break
            hi = min(size, hi + K.PIECE)
        yield cuts, np.append(cuts[1:], stop), np.searchsorted(offsets, cuts, "right") - 1
        lo = stop


class _Document:
    __slots__ = ("digest", "numbers", "words", "begun")

    def __init__(self):
        self.digest, self.numbers, self.words, self.begun = hashlib.sha256(), np.zeros(5, np.int64), [], False


def align_slice(texts: pa.Array, words: Words) -> pa.RecordBatch:
    """A row for each text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs and their multiplicity."""
    spaced = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "")
    spaced = pc.if_else(pc.equal(spaced, " "), "", spaced)
    data, offsets = K.buffer_of(spaced)
    n = len(texts)
    docs = [_Document() for _ in range(n)]
    for begin, end, text in _pieces(data, offsets):
        bounds = np.append(begin, end[-1]) - begin[0]
        run = data[begin[0] : end[-1]]
        column = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(run))])
        coded = column.dictionary_encode()
        place = words.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        edges = np.flatnonzero(np.append(True, np.diff(text) > 0))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(text)]):
            doc, own = docs[int(text[a])], place[a:b]
            if doc.begun:
                doc.digest.update(b";")
            doc.begun = True
            doc.digest.update(b";".join(map(words.digests.__getitem__, own.tolist())))
            which, often = np.unique(own, return_counts=True)
            doc.numbers += often @ words.numbers[which].astype(np.int64)
            size = words.counts[which]
            at = np.repeat(words.starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
            doc.words.append((words.pairs[at], words.times[at].astype(np.int64) * np.repeat(often, size)))
    numbers, digests, pairs, times = np.zeros((n, 4), np.int64), [""] * n, [], []
    sizes = np.zeros(n, np.int64)
    for i, doc in enumerate(docs):
        if not doc.begun or doc.numbers[4]:
            continue
        numbers[i], digests[i] = doc.numbers[:4], doc.digest.hexdigest()
        got, often = (np.concatenate(x) for x in zip(*doc.words))
        order = np.argsort(got, kind="stable")
        got, often = got[order], often[order]
        first = np.flatnonzero(np.append(True, got[1:] != got[:-1]))
        pairs.append(got[first])
        times.append(np.add.reduceat(often, first))
        sizes[i] = len(first)
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    columns = [pa.array(c) for c in numbers.T] + [pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(flat(pairs))), pa.ListArray.from_arrays(ends, pa.array(flat(times)))], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


_known: dict[tuple[str, str], Words] = {}


def _aligner(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_level, pieces) not in _known:
            _known[byte_level, pieces] = Words(Pair(byte_level, pieces))
        words = _known[byte_level, pieces]
        for batch in batches:
            for rows in K.slices(batch, 0):
                got = align_slice(rows.column(0), words)
                words.settle()
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], *got.columns], names=[*rows.schema.names[1:], *got.schema.names])

    return run


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, byte_level: str, pieces: str, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Each document's kept columns (under names by place: k0, k1, ...) with its numbers, digest and linked pairs of ids."""
    kept = [c.alias(f"k{n}") for n, c in enumerate(every(keep))]
    rows = small_batches(docs).select(F.col("text").cast("string").alias("t"), *kept)
    schema = T.StructType(rows.schema.fields[1:] + T.StructType.fromDDL(FOUND).fields)
    return rows.mapInArrow(_aligner(byte_level, pieces), schema)


def align(docs: DataFrame, byte_level: str, pieces: str, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts links whose pair's count is the highest of its A id in all documents,
    count_sum adds up all links' counts.
    """
    from sentencepiece import SentencePieceProcessor

    spark, keep = docs.sparkSession, list(keep)
    base = SentencePieceProcessor(model_file=pieces).get_piece_size()
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    aligned(docs, byte_level, pieces, keep).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/documents")
    held = spark.read.parquet(f"{folder}/documents")
    counts = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    most = counts.groupBy(F.floor(F.col("pair") / base).alias("a")).agg(F.max("count").alias("most"))
    rated = counts.withColumn("a", F.floor(F.col("pair") / base)).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    few = counts.count() <= BROADCAST_PAIRS
    links = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    joined = links.join(F.broadcast(rated) if few else rated, "pair")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = held.drop("pairs", "times").join(sums, "row", "left")
    names = [c.alias(k) for k, c in zip(keep, every(f"k{n}" for n in range(len(keep))))]
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return out.select(*names, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
