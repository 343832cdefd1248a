"""Near-duplicate terms: four strategies over terms(ord, term), and their union.

Every strategy is an equi-join on a blocking key with the test in the join condition,
so rejected pairs are never materialised, and a pair is produced at one key only, so
none has to be deduplicated.  Pairs come as (ord1, ord2, term1, term2, match_type,
score); ord is the terms' order, on which orientation depends.

Keys are ordered by how many terms have them.  What lies in another term has all its
six-character pieces there, so it is looked up at its rarest piece alone; terms with
tokens in common meet at the rarest of these.  A key of many terms is cut into cells, so
no task gets more than a bounded part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import bound_of, ratio_of, raw_tokens, token_set_bound, token_set_ratio

# Brackets around an abbreviation in a term, and a bare abbreviation.
HOSTED = r"\(([A-Z][A-Z0-9\-]{1,7})\)"
BARE = r"^[A-Z][A-Z0-9\-]{1,6}$"
PRIORITY = ("abbreviation", "case", "containment", "token_set")


def _pairs(joined: DataFrame, first: str, second: str, kind: str, score: Column) -> DataFrame:
    return joined.select(F.col(f"{first}.ord").alias("ord1"), F.col(f"{second}.ord").alias("ord2"), F.col(f"{first}.term").alias("term1"), F.col(f"{second}.term").alias("term2"), F.lit(kind).alias("match_type"), score.cast("double").alias("score"))


def abbreviation_pairs(terms: DataFrame) -> DataFrame:
    """An all-capitals term with each longer term that has it in brackets."""
    hosts = terms.select("ord", "term", F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit(HOSTED), F.lit(1)))).alias("key")).alias("h")
    bare = terms.where(F.col("term").rlike(BARE)).alias("b")
    return _pairs(bare.join(hosts, F.expr("b.term = h.key AND h.term <> b.term")), "b", "h", "abbreviation", F.lit(1.0))


def case_pairs(terms: DataFrame) -> DataFrame:
    """Terms that are equal once normalised; the earlier one first."""
    keyed = terms.select("ord", "term", T.normalised("term").alias("norm"))
    a, b = keyed.alias("a"), keyed.alias("b")
    return _pairs(a.join(b, F.expr("a.norm = b.norm AND a.ord < b.ord")), "a", "b", "case", F.lit(1.0))


#: Terms of a key that one cell takes.
CELL = 2000
#: Characters of a piece.
PIECE = 6


def _keyed(terms: DataFrame) -> DataFrame:
    return terms.select("ord", "term", T.normalised("term").alias("norm"), T.block_tokens("term").alias("tokens"))


def _cells(many: str = "many") -> Column:
    return F.floor((F.col(many) - 1) / CELL).cast("int") + 1


def _own(cells: str = "cells") -> Column:
    return F.pmod(F.xxhash64("ord"), F.col(cells)).cast("int")


def containment_candidates(terms: DataFrame, test: Column | None = None) -> DataFrame:
    """Pairs of an inner term and one that has the inner one's rarest piece: i_ and o_ord, term, norm, tokens.

    A term shorter than a piece has one token, which the outer one must have; it is looked
    up there.  test is a condition on the pair.
    """
    keyed = _keyed(terms)
    places = F.sequence(F.lit(1), F.length("norm") - PIECE + 1)
    long = F.length("norm") >= PIECE
    pieces = F.when(long, F.array_distinct(F.transform(places, lambda i: F.substring("norm", i, F.lit(PIECE))))).otherwise(F.array().cast("array<string>"))
    whole = lambda t: F.concat(F.lit("="), t)  # noqa: E731  a token, beside pieces
    held = keyed.withColumn("pieces", pieces)
    outer = held.select("ord", "term", "norm", "tokens", F.explode(F.array_distinct(F.concat("pieces", F.transform("tokens", whole)))).alias("key"))
    counts = outer.groupBy("key").agg(F.count("*").alias("many"))
    # the rarest piece of each term
    of_pieces = held.select("ord", F.explode("pieces").alias("key")).join(counts, "key")
    of_tokens = keyed.where(~long).select("ord", whole(F.get("tokens", F.lit(0))).alias("key")).join(counts, "key")
    rarest = of_pieces.groupBy("ord").agg(F.min(F.struct("many", "key")).alias("r")).select("ord", "r.key", "r.many").union(of_tokens.select("ord", "key", "many"))
    inner = rarest.withColumn("cells", _cells()).join(keyed, "ord").select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), *[F.col(c).alias(f"i_{c}") for c in ("ord", "term", "norm", "tokens")])
    hot = counts.where(F.col("many") > CELL).select("key", _cells().alias("cells"))
    dealt = outer.join(hot, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    dealt = dealt.select("key", _own().alias("cell"), *[F.col(c).alias(f"o_{c}") for c in ("ord", "term", "norm", "tokens")])
    met = inner.join(dealt, (inner["key"] == dealt["key"]) & (inner["cell"] == dealt["cell"]) & F.expr("i_ord <> o_ord") & (F.lit(True) if test is None else test))
    return met.drop("key", "cell")


def containment_pairs(terms: DataFrame, min_len: int = 6) -> DataFrame:
    """A term that contains another one, where they share a token; the shorter first.

    Only the earlier term has to have min_len characters.  The score is the ratio of
    their lengths, below 0.95.
    """
    score = F.bround(F.length("i_norm") / F.length("o_norm"), 3)
    inside = F.expr("i_norm <> o_norm AND contains(o_norm, i_norm) AND arrays_overlap(i_tokens, o_tokens)")
    earlier = F.length(F.when(F.col("i_ord") < F.col("o_ord"), F.col("i_norm")).otherwise(F.col("o_norm")))
    found = containment_candidates(terms, inside & (earlier >= min_len) & (score < 0.95))
    return found.select(F.col("i_ord").alias("ord1"), F.col("o_ord").alias("ord2"), F.col("i_term").alias("term1"), F.col("o_term").alias("term2"), F.lit("containment").alias("match_type"), score.alias("score"))


def token_candidates(terms: DataFrame, test: Column | None = None) -> DataFrame:
    """Pairs of terms with a token in common, met at the rarest: a_ and b_ord, term, norm, raw; the earlier first.

    A key's terms are dealt to cells, and each pair of cells meets in one place.  test is a
    condition on the pair.
    """
    keyed = _keyed(terms)
    blocked = keyed.select("ord", F.explode("tokens").alias("token"))
    counts = blocked.groupBy("token").agg(F.count("*").alias("many"))
    ranked = blocked.join(counts, "token").groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("ranked"))
    rows = keyed.select("ord", "term", "norm", raw_tokens("term").alias("raw")).join(ranked, "ord")
    each = rows.select("ord", "term", "norm", "raw", F.transform("ranked", lambda r: r["token"]).alias("ranked"), F.explode("ranked").alias("r")).select("*", F.col("r.token").alias("token"), F.col("r.many").alias("many"))
    each = each.where("many > 1").withColumn("cells", _cells()).withColumn("own", _own())
    all_cells = F.sequence(F.lit(0), F.col("cells") - 1)
    side = lambda name, cell: each.select("token", F.explode(F.transform(all_cells, cell)).alias("cell"), *[F.col(c).alias(f"{name}_{c}") for c in ("ord", "term", "norm", "raw", "ranked")])
    a, b = side("a", lambda j: F.col("own") * F.col("cells") + j), side("b", lambda i: i * F.col("cells") + F.col("own"))
    once = F.expr("a_ord < b_ord AND a_norm <> b_norm") & (a["token"] == F.get(F.array_intersect("a_ranked", "b_ranked"), F.lit(0)))
    met = a.join(b, (a["token"] == b["token"]) & (a["cell"] == b["cell"]) & once & (F.lit(True) if test is None else test))
    return met.drop("token", "cell", "a_ranked", "b_ranked")


def token_set_pairs(terms: DataFrame, threshold: float = 80) -> DataFrame:
    """Terms that share a token and have at least that token-set ratio; the earlier first."""
    near = token_candidates(terms, bound_of(F.col("a_raw"), F.col("b_raw")) >= threshold)
    scored = near.withColumn("ratio", ratio_of(F.col("a_raw"), F.col("b_raw"))).where(F.col("ratio") >= threshold)
    return scored.select(F.col("a_ord").alias("ord1"), F.col("b_ord").alias("ord2"), F.col("a_term").alias("term1"), F.col("b_term").alias("term2"), F.lit("token_set").alias("match_type"), F.bround(F.col("ratio") / 100, 3).alias("score"))


def all_pairs(terms: DataFrame, threshold: float = 80) -> DataFrame:
    """Each unordered pair once, by the first strategy that finds it.

    terms may have books (array of book keys): then books1, books2 and n_union, the
    size of their union, are added.
    """
    found = abbreviation_pairs(terms).union(case_pairs(terms)).union(containment_pairs(terms)).union(token_set_pairs(terms, threshold))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("match_type"))
    best = found.groupBy(F.least("ord1", "ord2").alias("low"), F.greatest("ord1", "ord2").alias("high")).agg(F.min_by(F.struct("ord1", "ord2", "term1", "term2", "match_type", "score"), F.struct(rank, "ord1")).alias("p")).select("p.*")
    if "books" not in terms.columns:
        return best
    books = lambda n: terms.select(F.col("ord").alias(f"ord{n}"), F.col("books").alias(f"books{n}"))
    both = best.join(books(1), "ord1").join(books(2), "ord2")
    return both.withColumn("n_union", F.size(F.array_union("books1", "books2")))


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the most books first, then the highest score."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("match_type"))
    return pairs.orderBy(F.desc("n_union"), F.desc("score"), rank, "ord1", "ord2")


def search(terms: DataFrame, query: str, limit: int = 20, cutoff: float = 50) -> DataFrame:
    """The terms most like a query (0 to 100), ties in term order."""
    bounded = terms.where(token_set_bound(F.col("term"), F.lit(query)) >= cutoff)
    scored = bounded.withColumn("score", token_set_ratio(F.col("term"), F.lit(query)))
    return scored.where(F.col("score") >= cutoff).orderBy(F.desc("score"), "term").limit(limit)


