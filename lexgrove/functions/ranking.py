"""Row numbers over a whole table without sending it to one task, and points in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable

#: Row ids hold the partition above this many bits, the row's place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[tuple[Column, bool]], name: str = "ord", start: int = 1) -> DataFrame:
    """The rows with their place in the given order, from `start`; order: (column, whether it descends).

    Range partitioning sorts the table into parts, and each part counts its own rows; the
    sizes of the parts before it (a row for each part) are added.  The sorted parts are
    written once: range bounds are sampled, so a second evaluation could cut elsewhere,
    and numbers would repeat or be left out.  The order must be total for a repeatable
    numbering.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[c.alias(f"_order{i}") for i, (c, _) in enumerate(order)])
    keys = [F.col(f"_order{i}").desc() if down else F.col(f"_order{i}").asc() for i, (_, down) in enumerate(order)]
    cut = durable(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*df.columns, F.monotonically_increasing_id().alias("_row")))
    part = F.shiftright("_row", PLACE_BITS).alias("_part")
    sizes = cut.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # a row for each part, whatever the input
    out = cut.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*df.columns, (place + F.col("_before") + start).cast("long").alias(name))


#: Blocks that ranges meet points in have a size of 2 to a multiple of this, the least that takes the range.
BLOCK_BITS = 4
#: Sizes up to what a long holds.
BLOCK_LEVELS = 16


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """points joined to the ranges of the same keys that hold them, both ends included; null ends hold nothing.

    Points and ranges meet in blocks of the range's own size, of which a range has two or
    so, and a point is tested against ranges near it and not against all of its key, however
    long or nested ranges are.  A point goes to the sizes alone that ranges of its key have.
    """
    block = lambda at, level: F.call_function("shiftright", at.cast("long"), level * BLOCK_BITS)
    at, start, end = F.col(point), F.col(low), F.col(high)
    span = end.cast("long") - start.cast("long")
    level = F.size(F.filter(F.sequence(F.lit(0), F.lit(BLOCK_LEVELS - 2)), lambda n: block(span, n) > 0))
    sized = ranges.where(start <= end).withColumn("_level", level)
    held = sized.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    blocked = sized.withColumn("_block", F.explode(F.sequence(block(start, F.col("_level")), block(end, F.col("_level")))))
    spread = points.join(held, keys).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_block", block(at, F.col("_level")))
    return spread.join(blocked, [*keys, "_level", "_block"]).where(at.between(start, end)).drop("_level", "_block")
