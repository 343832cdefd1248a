"""Filter interaction audit, with duplicates by partition refinement.

Every document gets a mask of the filters it fails.  How filters act in any order follows
from how many documents have each mask: a filter removes, behind a set of earlier ones,
the documents that fail it and none of these.

Copies are found by refining a partition: documents are split by their code-point length,
then by the hashes of successive blocks (each twice as long as the one before), and each
round drops what stands alone.  The texts of what is left are compared whole; of equal
ones all but the smallest id fail.  Rounds move a few numbers for each document; a text
moves only where it has survived them, once for each task that holds it.

A null text is empty, and empty texts are copies of each other.  A null id is larger and
smaller than none: such a row is no copy and makes none.  Rows of one id are no copies of
each other.  A null part is ''.  A document is good or toxic if one of its labels says so;
labels with a null id or value say nothing.  An empty table gives no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

FILTERS = "ABCDE"
#: Code points of the first block.
BLOCK = 256
#: Surviving classes whose hashes go to all tasks; beyond, they are joined with the texts.
BROADCAST_CLASSES = 1 << 20

# What parts words, and the characters that condition D names.
SPACES = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"


def block_hashes(text: Column, n: Column) -> Column:
    """Hashes of the text's blocks of 256, 512, 1024, ... code points; none of an empty text."""
    blocks = F.length(F.bin(F.floor((n - 1) / BLOCK) + 1))
    place = lambda k: F.call_function("shiftleft", F.lit(BLOCK), k)
    hashes = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64(F.substring(text, place(k) - BLOCK + 1, place(k))))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<long>"))


def refined(first: Column, hashes: Column) -> Column:
    """The class that a text's length and all its blocks lead to."""
    return F.aggregate(hashes, first.cast("long"), lambda c, h: F.xxhash64(c, h))


def surviving_classes(marks: DataFrame) -> DataFrame:
    """(class): the final classes of several documents; marks has n and hashes.

    Documents alike in length and all hashes go through the rounds as one row.
    """
    alive, done, k = durable(marks.groupBy(F.col("n").cast("long").alias("class"), "hashes").agg(F.count("*").alias("docs"))), None, 0
    while True:
        several = alive.groupBy("class").agg(F.sum("docs").alias("all")).where("all > 1").select("class")
        alive = durable(alive.join(several, "class", "left_semi"))
        ended = alive.where(F.size("hashes") <= k).select("class").distinct()
        done = ended if done is None else done.union(ended)
        alive = alive.where(F.size("hashes") > k)
        if alive.isEmpty():
            return durable(done)
        alive, k = alive.select(F.xxhash64("class", F.get("hashes", F.lit(k))).alias("class"), "hashes", "docs"), k + 1


def least_copies(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts that several documents have: (class, least) where the class has one text, (id, class, text_least) elsewhere.

    docs has id, text and class; marks has n and hashes of the same rows.
    """
    classes = surviving_classes(marks)
    few = classes.count() <= BROADCAST_CLASSES
    left = docs.join(F.broadcast(classes) if few else classes, "class", "left_semi")
    texts = durable(left.groupBy("class", "text").agg(F.min("id").alias("least")))
    held = texts.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least"))
    # different texts with equal hashes throughout: by their text
    mixed = durable(held.where("texts > 1").select("class"))
    apart = left.join(F.broadcast(mixed), "class", "left_semi").join(texts, ["class", "text"]).groupBy("id", "class").agg(F.min("least").alias("text_least")) if not mixed.isEmpty() else None
    return held.where("texts = 1").select("class", "least"), apart


def failures(docs: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask): bit k of a row's mask is set where it fails the k-th filter."""
    whole = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n, hashes = F.char_length("text"), block_hashes(F.col("text"), F.char_length("text"))
    measured = whole.select("id", "part", "text", n.alias("n"), hashes.alias("hashes"), F.array_remove(F.split("text", SPACES), "").alias("words"))
    counted = measured.select("*", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    fails = [F.col("n_words") < 200, F.col("n_distinct") * 100 < F.col("n_words") * 50, F.regexp_count("text", F.lit("[A-Z]")).cast("long") * 100 > F.col("n").cast("long") * 2, F.col("text").rlike(SIGNS)]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    marks = durable(counted.select("id", "part", mask.alias("mask"), "n", "hashes", refined(F.col("n"), F.col("hashes")).alias("class")))
    texts = whole.where("id IS NOT NULL").select("id", "text", refined(n, hashes).alias("class"))
    least, apart = least_copies(texts, marks.where("id IS NOT NULL").select("n", "hashes"))
    joined = marks.select("id", "part", "mask", "class").join(least, "class", "left")
    first = F.col("least")
    if apart is not None:
        joined, first = joined.join(apart, ["id", "class"], "left"), F.coalesce("least", "text_least")
    copy = F.coalesce(F.col("id") > first, F.lit(False))
    return joined.select("id", "part", (F.col("mask") + copy.cast("int") * 16).alias("mask"))


def audit(failed: DataFrame, labels: DataFrame, ident: str = "doc_id") -> DataFrame:
    """A row for each part, order of the five filters and step; failed has (id, part, mask)."""
    spark = failed.sparkSession
    says = labels.groupBy(F.col(ident).cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    masks = failed.join(says, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # at most 32 masks of a part, in one row
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    bits = [1 << k for k in range(len(FILTERS))]
    states = [(own, sum(before)) for own in bits for size in range(len(bits)) for before in combinations([b for b in bits if b != own], size)]
    at = parts.select("part", "masks", F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in states])).alias("s")).select("part", "masks", "s.own", "s.before")

    def total(name: str, when) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(when(m["mask"]), m[name]).otherwise(0))

    fails, earlier = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    first = lambda m: fails(m) & ~earlier(m)
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(fails(m["mask"]), m["n"] * F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.greatest(F.bit_count(m["mask"]), F.lit(1)))).otherwise(F.lit(0).cast("long")))
    counts = at.select(
        "part",
        "own",
        "before",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        # a document that fails m filters is removed by each of them in 120 / m orders
        share.alias("shapley"),
    )
    steps = [("".join(order), step + 1, bits[FILTERS.index(letter)], sum(bits[FILTERS.index(x)] for x in order[:step])) for order in permutations(FILTERS) for step, letter in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, own int, before int")
    return F.broadcast(orders).join(counts, ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
