"""URL filters by a sort-merge range join, with DataFrame functions only.

A url's host is reversed label by label ("www.example.net" becomes
"net.example.www"), so that a rule for a host and its subdomains with a path prefix
is an interval of the keys

    first d labels of the reversed host + "\\x01" + path,   d the rule's label count,

namely all keys that begin with the rule's own key.  Each url makes one key for each
label count that rules have.  Keys and rules are sorted together by range
partitioning; a running window keeps, for each nesting level of rules, the rule that
was opened last, which together are the stack of active nested rules; whatever is open
at the end of a partition is carried into the next ones.  A stack entry that does not
begin the key has closed.  The longest active rule decides.

Rules that nest are told apart by level: the number of other rules whose key begins
theirs.  Rules of one level are disjoint intervals, so the one opened last is the only
one of its level that can be active.

Equal keys spread over partitions (the sort key ends in a salt), repeated urls are
folded before the last shuffle, and nothing but rule counts by partition is broadcast.
The bounds of the partitions are sampled, so the sweep is written once and both the
stacks and what is carried are read from that: rules lie in one part for all.
A null url, or one without "://", has an empty host and path and fits no rule.  A rule
with a null or empty host fits nothing; a null path is an empty one.  Of equal rules
with both verdicts, block stays.  Repeated rows are all returned; an empty
table of urls gives an empty result; without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable

END = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url column; both empty where there is no "://"."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.")))


def _ruled(rules: DataFrame) -> DataFrame:
    """key, labels, level, rule, verdict of each distinct rule."""
    rules = rules.where("host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    labels = _labels(F.col("host"))
    rules = rules.select(F.concat(F.array_join(labels, "."), F.lit(END), F.col("path")).alias("key"), F.size(labels).alias("labels"), F.concat("host", "path").alias("rule"), "verdict")
    rules = rules.groupBy("key", "labels", "rule").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    # a rule's outer rules have the same host part, so only prefixes that reach into the path count
    prefixes = rules.select("key", F.explode(F.sequence(F.instr("key", END), F.length("key"))).alias("n")).select("key", F.substr("key", F.lit(1), F.col("n")).alias("outer"))
    levels = prefixes.join(rules.select(F.col("key").alias("outer")), "outer").groupBy("key").agg((F.count("*") - 1).cast("int").alias("level"))
    return rules.join(levels, "key").select("key", "labels", "level", "rule", F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ids: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """ids, host, path, rule (null where none fits) and verdict of every url.

    rules: host, path (a prefix), verdict (allow or block).
    """
    spark = pages.sparkSession
    host, path = host_and_path(url)
    urls = pages.select(*ids, host.alias("host"), path.alias("path"))
    ruled = _ruled(rules)
    shape = ruled.agg(F.array_sort(F.collect_set("labels")).alias("labels"), F.max("level").alias("level")).first()
    if shape.level is None:
        return urls.select(*ids, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    levels = range(shape.level + 1)

    labels = _labels(F.col("host"))
    depths = F.filter(F.array(*[F.lit(n) for n in shape.labels]), lambda n: n <= F.size(labels))
    keys = F.transform(depths, lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(END), F.col("path")))
    keyed = urls.select(*ids, "host", "path", F.posexplode_outer(keys).alias("nth", "key"))

    nothing = {c: F.lit(None).cast(urls.schema[c].dataType) for c in (*ids, "host", "path")}
    none = F.lit(None)
    opened = ruled.select(*[v.alias(c) for c, v in nothing.items()], none.cast("int").alias("nth"), "key", F.struct("key", "rule", "verdict").alias("opens"), "level", F.lit(0).alias("is_url"), F.lit(0).alias("salt"))
    asked = keyed.select(*ids, "host", "path", "nth", F.coalesce("key", F.lit("")).alias("key"), none.cast("struct<key:string,rule:string,verdict:string>").alias("opens"), none.cast("int").alias("level"), F.lit(1).alias("is_url"), F.pmod(F.xxhash64(*ids), F.lit(1 << 20)).cast("int").alias("salt"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = opened.union(asked).repartitionByRange(parts, "key", "is_url", "salt").withColumn("part", F.spark_partition_id())

    so_far = Window.partitionBy("part").orderBy("key", "is_url", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacks = [F.last(F.when(F.col("level") == n, F.col("opens")), ignorenulls=True).over(so_far).alias(f"open_{n}") for n in levels]
    swept = durable(dealt.select(*ids, "host", "path", "nth", "key", "level", "is_url", "part", F.when(F.col("is_url") == 0, F.col("opens")).alias("opens"), *stacks))
    stack = swept.where("is_url = 1")

    # what is open when a partition begins: the last rule of each level in the partitions before
    last = swept.where("is_url = 0").groupBy("part", "level").agg(F.max_by("opens", "key").alias("opens"))
    marks = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.explode(F.array(*[F.lit(n) for n in levels])).alias("level"), none.cast("struct<key:string,rule:string,verdict:string>").alias("opens"))
    before = Window.partitionBy("level").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.union(last.select("part", "level", "opens")).withColumn("carry", F.last("opens", ignorenulls=True).over(before))
    carried = carried.groupBy("part").agg(*[F.max(F.when(F.col("level") == n, F.col("carry"))).alias(f"carry_{n}") for n in levels])

    # one row for each partition, whatever the input
    both = stack.join(F.broadcast(carried), "part", "left")
    active = F.filter(F.array(*[F.coalesce(f"open_{n}", f"carry_{n}") for n in levels]), lambda r: r.isNotNull() & F.startswith(F.col("key"), r["key"]))
    best = F.array_max(F.transform(active, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    found = both.select(*ids, "host", "path", "nth", best.alias("best")).groupBy(*ids, "host", "path").agg(F.max("best").alias("best"), F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, 1).otherwise(0)).cast("int").alias("copies"))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(*ids, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
