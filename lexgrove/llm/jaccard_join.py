"""N-gram Jaccard join by signature trees (exact).

`jaccard_components` links texts whose sets of distinct k-word shingles have
100 * |intersection| >= least * |union| and returns the connected components.

What makes candidates is a key, what tests them is a tree.  Plan, in terms of rows:

1. One pass over the texts computes each text's shingle count, a 64-bit hash of its
   whole set (equal sets are one node from here on, so a group of exact copies of any
   size is one row) and the set's keys: its hash range is cut into m segments, and each
   segment's content is a key.  Two sets that link differ in at most H hashes (H follows
   from the sizes), so at least m - H of their m segments are equal.
2. In an order in which keys that one set alone has come first, and fuller segments
   before others, the first H + 1 keys of two sets that link have one in common.  So a
   set that has more than H keys to itself links with nothing, and of the keys that it
   shares only those stay that the first H + 1 reach.  Nothing that links is missed, and
   sets that merely share a passage or some frequent shingles lose what they share.
   Sets of one slice of a task that share a key know it on the spot; the key goes to the
   shuffle once for a slice, whatever the number of sets that have it.
3. Nodes that share keys, by way of others too, form blocks (connected components).
4. Each block goes to tasks as chunks bounded in sets and in shingles; a task holds
   two chunks, builds a signature tree over each and traverses them against each
   other, which drops all pairs below two tree nodes that cannot overlap enough.  A
   block of one chunk, as nearly all are, is settled by its task.  In larger ones
   every chunk meets itself and its block's first chunk; what that leaves outside the
   block's commonest component is dealt into chunks of its own, which meet each other
   and all of the block.  A group of near copies costs work in proportion to its size.
5. Verified links give the components.

Edge cases: a null or empty text (or one of white space alone) has an empty set,
n_shingles 0, and is its own component.  Repeated rows are all returned; rows with
equal doc_id and different texts each have the component of their own text.  A row
with a null doc_id is returned with a null component and links nothing.  An empty table
gives an empty result.  Other columns are ignored.  Node identity is a 64-bit hash of
the set: two different sets among N would be taken for one with a chance of N * N / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .columns import small_batches
from .graph import components, durable
from .signature_tree import Groups, Tree, join, width_for

WORDS, LEAST = 4, 85
#: A chunk holds about so many sets, and about so many shingles, at most.
CHUNK_SETS, CHUNK_SHINGLES = 128, 500_000
#: A key's code: its level, the level's spare and its place there, in these bits; above them a mark.
SPARE_BITS = PLACE_BITS = 28
SHARED = 1 << 62
#: Up to so many ids (8 bytes each) are broadcast to pick the texts that have to move.
BROADCAST_IDS = 1_000_000


def _node(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((K.mix(s).sum(dtype=np.uint64) ^ K.mix(np.array([len(s)], np.uint64))[0]).astype(np.int64)) if len(s) else 0


def _hash_limit(n: int, most: int, least: int) -> int:
    """Most hashes in which sets of n and at most `most` can differ and link."""
    return (100 - least) * (n + min(most, 100 * n // least)) // (100 + least)


def _cap(m: int, least: int) -> int:
    """Largest set size for which m segments are enough, with a quarter to spare so that most are not empty."""
    if m == 1:
        return (100 + least - 1) // (2 * (100 - least))
    return int((100 + least) * (0.8 * m - 2.6) / (2 * (100 - least)))


def segment_keys(s: np.ndarray, least: int) -> list[tuple[int, int, np.ndarray]]:
    """(segments, spare, keys in their order) of one sorted set, for each number of segments that a partner may have.

    Of the keys that a set shares with others at all, the last `spare` are not needed: one
    of those before them is also one that a set which links shares, and has before its own.
    """
    n = len(s)
    m = 1
    while _cap(m, least) < n:
        m = m * 2 if m > 4 else 8
    out = []
    with np.errstate(over="ignore"):
        mixed = K.mix(s)
        while True:
            most = _hash_limit(n, _cap(m, least), least) + 1
            segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(segment, prepend=segment[:1] - np.uint64(1)))
            held = np.diff(np.append(starts, n))
            which = segment[starts]
            content = K.mix(np.add.reduceat(mixed, starts) + which * np.uint64(0x9FB21C651E98DF25) + np.uint64(m))
            keys = content[np.lexsort((content, -held))]
            if len(keys) < most:  # empty segments come last, in a fixed order
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), which)[: most - len(keys)]
                keys = np.append(keys, K.mix(empty * np.uint64(0x9FB21C651E98DF25) + np.uint64(m) + np.uint64(1 << 40)))
            out.append((m, max(0, len(keys) - most), keys))
            if 100 * n < least * (_cap(m, least) + 1):
                return out
            m = m * 2 if m > 4 else 8  # a partner may be too large for m segments


def _codes(levels: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """For each key its level, the level's spare and the key's place in one number."""
    return np.concatenate([((m.bit_length() << SPARE_BITS | spare) << PLACE_BITS) + np.arange(len(keys), dtype=np.int64) for m, spare, keys in levels])


def _sets(batches, text: str, k: int):
    for batch in batches:
        for part in K.slices(batch, text):
            yield part, list(K.shingle_sets(*K.buffer_of(part.column(text)), k))


def _rows(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, other, tag, n) of three kinds.

    A text: n is its number of shingles, other its doc_id.  A key of a node: n and tag are
    null, other is its code, with SHARED where other sets of the slice have it too.  A key
    that the slice has sent for another node: n is null, tag the key, other the code.
    The keys of the first and the last kind only spread the rows.
    """

    def out(key, node, other, tag, n):
        for at in range(0, len(key), 1 << 15):
            part = slice(at, at + (1 << 15))
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(node[part]), other[part], tag[part], n[part]], ["key", "node", "other", "tag", "n"])

    def nulls(many):
        return pa.nulls(many, pa.int64())

    for part, sets in _sets(batches, "text", k):
        node = np.fromiter((_node(s) for s in sets), np.int64, len(sets))
        yield from out(_spread(node, np.arange(len(node))), node, part.column("doc_id"), part.column("tag"), pa.array([len(s) for s in sets], pa.int64()))
        named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        unique = {int(node[i]): s for i, s in enumerate(sets) if named[i] and len(s)}
        if not unique:
            continue
        each = [segment_keys(s, least) for s in unique.values()]
        keys = np.concatenate([x for levels in each for _, _, x in levels]).view(np.int64)
        nodes = np.repeat(np.fromiter(unique, np.int64, len(unique)), [sum(len(x) for _, _, x in levels) for levels in each])
        codes = np.concatenate([_codes(levels) for levels in each])
        order = np.argsort(keys, kind="stable")
        keys, nodes, codes = keys[order], nodes[order], codes[order]
        first = np.append(True, keys[1:] != keys[:-1])
        several = np.append(~first[1:], False)
        sent = codes[first] + several[first] * SHARED
        yield from out(keys[first], nodes[first], pa.array(sent), nulls(len(sent)), nulls(len(sent)))
        rest = ~first
        yield from out(_spread(nodes[rest], keys[rest]), nodes[rest], pa.array(codes[rest]), pa.array(keys[rest]), nulls(int(rest.sum())))


def _spread(node: np.ndarray, more: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(node.view(np.uint64) + more.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _needed(shared: DataFrame) -> DataFrame:
    """(key, node, code) of the keys that nodes share -> (key, node) of those that a link needs."""
    one = shared.dropDuplicates(["node", "key", "code"])  # copies of a set in several slices
    level = F.shiftright("code", PLACE_BITS + SPARE_BITS)
    spare = F.shiftright("code", PLACE_BITS).bitwiseAND(F.lit((1 << SPARE_BITS) - 1))
    own = Window.partitionBy("node", "level")
    ranked = one.withColumn("level", level).withColumn("from_last", F.row_number().over(own.orderBy(F.desc("code"))))
    return ranked.where(F.col("from_last") > spare).select("key", "node")


def _grouped(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    """Runs of rows with the same value of a column, from sorted batches."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[name] != rows[-1][name]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _tree_links(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """(node, component of the task) for all nodes that links join to a smaller one in a task's two chunks.

    Side 0 is the first chunk.
    """
    a, b = [], []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a.clear(), b.clear()
        return out

    for rows in _grouped(batches, "task"):
        sides: list[list[dict]] = [[], []]
        sets: list[list[np.ndarray]] = [[], []]
        for row in rows:  # the text of another row with the same doc_id is left out
            s = next(K.shingle_sets(*K.buffer_of(pa.array([row["text"]], pa.large_string())), k))
            if _node(s) == row["node"] and not (sides[row["side"]] and sides[row["side"]][-1]["node"] == row["node"]):
                sides[row["side"]].append(row)
                sets[row["side"]].append(s)
        # what is known to be one component already needs no second look
        known: dict[int, int] = {}
        groups = Groups(len(rows))
        for at, row in enumerate(sides[0] + sides[1]):
            if row["component"] is not None:
                groups.union(known.setdefault(row["component"], at), at)
        width = width_for([*sets[0], *sets[1]]) if sets[0] or sets[1] else 256
        trees = [Tree(side, width) if side else None for side in sets]
        inside = [(0, 0), (1, 1)] if rows[0]["within"] == 2 else [(1, 1)] if rows[0]["within"] == 1 else []
        for x, y in [*inside, (0, 1)]:
            if trees[x] is not None and trees[y] is not None:
                starts = (0, len(sides[0]))
                join(trees[x], trees[y], least, groups, (starts[x], starts[y]))
        members: dict[int, list[int]] = {}
        for at, row in enumerate(sides[0] + sides[1]):
            members.setdefault(groups.find(at), []).append(row["node"])
        for nodes in members.values():
            low = min(nodes)
            a += [n for n in nodes if n != low]
            b += [low] * (len(nodes) - 1)
        if len(a) > 10_000:
            yield flush()
    yield flush()


def jaccard_components(docs: DataFrame, k: int = WORDS, least: int = LEAST, chunk_sets: int = CHUNK_SETS, chunk_shingles: int = CHUNK_SHINGLES, tag: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach from each row's text.

    With a tag (a long that tells apart rows of one doc_id, say a hash of the text), the
    rows also have tag and component_tag, those of the row and of the least (doc_id, tag).
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    rows = docs.mapInArrow(partial(_rows, k=k, least=least), "key long, node long, other long, tag long, n long")
    of_key = Window.partitionBy("key")
    met = rows.withColumns({"low": F.min("node").over(of_key), "high": F.max("node").over(of_key), "flag": F.max("other").over(of_key)})
    # keys of texts and of sent rows are of no account: a chance meeting there only keeps a row more
    kept = durable(met.where(f"n IS NOT NULL OR tag IS NOT NULL OR low <> high OR flag >= {SHARED}").select("key", "node", "other", "tag", "n"))
    signed = kept.where("n IS NOT NULL").select(F.col("other").alias("doc_id"), "tag", F.col("n").alias("n_shingles"), "node")
    shared = kept.where("n IS NULL").select(F.coalesce("tag", "key").alias("key"), "node", F.col("other").bitwiseAND(F.lit(SHARED - 1)).alias("code"))
    needed = durable(_needed(shared))
    leads = needed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select(F.bitwise_not("key").alias("key_of"), "lead")
    stars = needed.withColumn("_key", F.bitwise_not("key")).join(leads, F.col("_key") == F.col("key_of")).where("node <> lead")
    blocks = components(stars.select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("component", "block")

    # one row for each distinct set; those that share a key with another are dealt into chunks of their block
    distinct = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tag")).alias("least"), F.first("n_shingles").alias("n"))
    nodes = durable(distinct.select("node", "least.doc_id", "least.tag", "n").join(blocks, "node", "left"))
    inside = nodes.where("block IS NOT NULL")
    sizes = inside.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / chunk_sets), F.ceil(F.sum("n") / chunk_shingles)).cast("int").alias("chunks"))
    sizes = sizes.select(F.bitwise_not("block").alias("size_of"), "chunks")
    dealt = inside.withColumn("_block", F.bitwise_not("block")).join(sizes, F.col("_block") == F.col("size_of")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = durable(dealt.select("node", "doc_id", "tag", "block", "chunks", "chunk"))
    named = docs.where("doc_id IS NOT NULL")

    def visit(members: DataFrame) -> DataFrame:
        """members (node, doc_id, tag, task, side, within, component) -> nodes and their components (a, b) in each task."""
        # only the texts of members move; the members are broadcast where they are few, else the join sorts it out.
        # The tag is a range, not a second key, so that the members' table is one of single longs
        few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        own = members.select(F.col("doc_id").alias("member"), F.col("tag").alias("own_tag"), "task", "side", "within", "node", "component")
        same = (F.col("doc_id") == F.col("member")) & F.col("tag").between(F.col("own_tag"), F.col("own_tag"))
        texts = named.join(F.broadcast(own) if few else own, same).select("task", "side", "within", "node", "component", "text")
        return durable(texts.repartition("task").sortWithinPartitions("task", "side", "node").mapInArrow(partial(_tree_links, k=k, least=least), "a long, b long"))

    unknown = F.lit(None).cast("long").alias("component")
    own = placed.where("chunk > 0 OR chunks = 1").select("node", "doc_id", "tag", F.xxhash64("block", F.greatest("chunk", F.lit(1))).alias("task"), F.lit(1).alias("side"), F.lit(1).alias("within"), unknown)
    first = placed.where("chunk = 0 AND chunks > 1").withColumn("to", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)))
    first = first.select("node", "doc_id", "tag", F.xxhash64("block", "to").alias("task"), F.lit(0).alias("side"), F.when(F.col("to") == 1, 2).otherwise(1).alias("within"), unknown)
    links = visit(own.union(first))
    large = placed.where("chunks > 1").select("node")
    if large.isEmpty():  # every block was one task's
        joined = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        joined = joined.union(joined.select("component", "component").distinct())
    else:
        joined = components(links)
        # what the first round left outside its block's main component, in chunks of its own, against all of the block
        state = placed.where("chunks > 2").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = state.groupBy("block").agg(F.mode("component").alias("main")).select(F.bitwise_not("block").alias("main_of"), "main")
        state = durable(state.withColumn("_block", F.bitwise_not("block")).join(main, F.col("_block") == F.col("main_of")).select("node", "doc_id", "tag", "block", "chunk", "component", (F.col("component") != F.col("main")).alias("out")))
        outside = state.where("out")
        if not outside.isEmpty():
            many = outside.groupBy("block").agg(F.ceil(F.count("*") / chunk_sets).cast("int").alias("parts"))
            loose = durable(outside.join(many, "block").select("node", "doc_id", "tag", "block", "component", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), "parts"))
            parts = loose.select("block", "part").distinct()
            chunks = state.where("NOT out").select("block", "chunk").distinct()
            # a pair of parts, or a part and a chunk (numbered behind the parts)
            pairs = parts.join(chunks, "block").select("block", F.col("part").alias("i"), F.lit(None).cast("int").alias("j"), F.col("chunk").alias("k"))
            pairs = pairs.union(parts.alias("x").join(parts.alias("y"), F.expr("x.block = y.block AND x.part <= y.part")).select("x.block", F.col("x.part"), F.col("y.part"), F.lit(None).cast("int")))
            pairs = durable(pairs.withColumn("task", F.xxhash64("block", "i", F.coalesce("j", F.lit(-1)), F.coalesce("k", F.lit(-1)))))
            one = loose.join(pairs.select("block", F.col("i").alias("part"), "task", F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("within")), ["block", "part"])
            two = loose.join(pairs.where("i < j").select("block", F.col("j").alias("part"), "task"), ["block", "part"])
            rest = state.where("NOT out").join(pairs.where("k IS NOT NULL").select("block", F.col("k").alias("chunk"), "task"), ["block", "chunk"])
            side = lambda df, n, within: df.select("node", "doc_id", "tag", "task", F.lit(n).alias("side"), within.alias("within"), "component")
            more = visit(side(one, 0, F.col("within")).union(side(two, 1, F.lit(0))).union(side(rest, 1, F.lit(0))))
            joined = components(links.union(more))

    rooted = nodes.select("node", "doc_id", "tag").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("least")).select(F.bitwise_not("root").alias("root_of"), "least")
    named_nodes = rooted.withColumn("_root", F.bitwise_not("root")).join(smallest, F.col("_root") == F.col("root_of")).select("node", "least")
    whole = signed.join(named_nodes, "node", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own_id = lambda c: F.when(linked, F.col(f"least.{c}")).otherwise(F.col(c))
    out = whole.select("doc_id", "n_shingles", own_id("doc_id").alias("component_id"), "tag", own_id("tag").alias("component_tag"))
    return out if tag is not None else out.drop("tag", "component_tag")
