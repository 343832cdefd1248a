"""Claims: matching them to terms, and reading argument maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The claim line, a line of the citations block, a labelled line of the gap report.
CLAIM = r"""(?U)^↓\s+([?~*✓]|\*\?)?\s*(\w+)\s+\(([TER!])\)\s+"([^"]+)"(?:\s+\[([^\]]*)\])?"""
CITATION = r"(?U)^\s+(\w+)\s+\([^)]+\):\s*(.+)$"
GAP_LABEL = r"(?U)^(\w+)\s+\([^)]+\)\s+[—\-]\s+(.+)"
#: Line ends of texts that are read line by line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def match_claims(claims: DataFrame, terms: DataFrame, top_n: int | None = 10) -> DataFrame:
    """claims (claim_ord, text), terms (term, n_books) -> claim_ord, term, n_books, token_overlap, score, place.

    A term matches a claim if they share a significant token; overlap is the share of
    the claim's distinct tokens that the term has, score is overlap times books.  The
    best top_n of each claim stay (all if None); a claim without tokens has none.
    """
    asked = claims.select("claim_ord", F.array_distinct(T.significant_tokens("text")).alias("tokens"))
    asked = asked.select("claim_ord", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    held = terms.select("term", "n_books", F.explode(F.array_distinct(T.significant_tokens("term"))).alias("token"))
    shared = asked.join(held, "token").groupBy("claim_ord", "term", "n_books", "n_tokens").agg(F.count("*").alias("n"))
    overlap = F.col("n") / F.col("n_tokens")
    scored = shared.select("claim_ord", "term", "n_books", F.bround(overlap, 3).alias("token_overlap"), F.bround(overlap * F.col("n_books"), 3).alias("score"))
    best = Window.partitionBy("claim_ord").orderBy(F.desc("score"), F.desc("n_books"), "term")
    placed = scored.withColumn("place", F.row_number().over(best))
    return placed if top_n is None else placed.where(F.col("place") <= top_n)


def match_claim(text: str, terms: DataFrame, top_n: int = 10) -> DataFrame:
    """The matches of one claim, best first."""
    one = terms.sparkSession.range(1).select(F.col("id").alias("claim_ord"), F.lit(text).alias("text"))
    return match_claims(one, terms, top_n).drop("claim_ord").orderBy("place")


def with_matches(claims: DataFrame, terms: DataFrame, top_n: int = 10) -> DataFrame:
    """claims with all their columns and an array of matches, empty where there is none."""
    found = match_claims(claims, terms, top_n)
    packed = found.groupBy("claim_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "n_books", "token_overlap", "score"))), lambda x: F.struct(x["term"].alias("term"), x["n_books"].alias("n_books"), x["token_overlap"].alias("token_overlap"), x["score"].alias("score"))).alias("matches"))
    kind = packed.schema["matches"].dataType.simpleString()
    return claims.join(packed, "claim_ord", "left").withColumn("matches", F.coalesce("matches", F.array().cast(kind)))


def amap_lines(files: DataFrame) -> DataFrame:
    """files (file, text) -> file, line_no from 0, line."""
    return files.select("file", F.posexplode(F.split("text", LINE_END)).alias("line_no", "line"))


def parse_claims(lines: DataFrame) -> DataFrame:
    """The claim lines: file, claim_ord (line), label, status, type, text, citations."""
    line = T.strip("line")
    part = lambda n: F.regexp_extract("stripped", CLAIM, n)
    cited = F.filter(F.transform(F.split(part(5), ";"), T.strip), lambda c: c != "")
    found = lines.withColumn("stripped", line).where(F.col("stripped").rlike(CLAIM))
    return found.select("file", F.col("line_no").alias("claim_ord"), part(2).alias("label"), part(1).alias("status"), part(3).alias("type"), part(4).alias("text"), cited.alias("citations"))


def priority_claims(claims: DataFrame) -> DataFrame:
    """Stubs, then drafts, with their place in each file."""
    wanted = claims.where(F.col("status").isin("?", "~"))
    order = Window.partitionBy("file").orderBy(F.when(F.col("status") == "?", 0).otherwise(1), "claim_ord")
    return wanted.withColumn("priority", F.row_number().over(order))


def citations_block(lines: DataFrame) -> DataFrame:
    """The CITATIONS block of each file: file, label, refs; of a repeated label, the last."""
    until = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opens = T.strip("line") == "CITATIONS"
    begun = F.coalesce(F.max(opens.cast("int")).over(until), F.lit(0)) == 1
    marked = lines.withColumn("opens", opens).withColumn("begun", begun)
    ends = F.col("begun") & ~F.col("opens") & (F.col("line") != "") & ~F.col("line").rlike(r"(?U)^[\s\x1c-\x1f]")
    inside = marked.withColumn("over", F.max(ends.cast("int")).over(until.rowsBetween(Window.unboundedPreceding, 0)) == 1).where("begun AND NOT over AND NOT opens")
    rows = inside.where(F.col("line").rlike(CITATION)).select("file", "line_no", F.regexp_extract("line", CITATION, 1).alias("label"), F.filter(F.transform(F.split(F.regexp_extract("line", CITATION, 2), ","), T.strip), lambda c: c != "").alias("refs"))
    return rows.groupBy("file", "label").agg(F.max_by("refs", "line_no").alias("refs"))


def gap_report(lines: DataFrame) -> DataFrame:
    """The fenced gap report of each file: file, section, line_no, label, note (structural gaps have no label)."""
    order = Window.partitionBy("file").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    line = T.strip("line")
    marked = lines.withColumn("s", line).withColumn("begun", F.coalesce(F.max((line == "## Gap report").cast("int")).over(before), F.lit(0)) == 1)
    fences = F.sum((F.col("begun") & (F.col("s") == "```")).cast("int")).over(order)
    body = marked.withColumn("fences", fences).where("begun AND fences = 1 AND s <> '```' AND s <> '## Gap report' AND s <> '' AND NOT startswith(s, '─')")
    section = F.when(F.col("s").startswith("STRUCTURAL GAPS"), "structural").when(F.contains("s", F.lit("NAKED ASSERTIONS")), "naked_assertions").when(F.col("s").startswith("STUBS"), "stubs")
    body = body.withColumn("title", section).withColumn("section", F.last("title", ignorenulls=True).over(order)).where("title IS NULL AND section IS NOT NULL")
    labelled = F.col("section") != "structural"
    kept = body.where(F.when(labelled, F.col("s").rlike(GAP_LABEL)).otherwise(F.col("s").rlike(r"^G\d")))
    return kept.select("file", "section", "line_no", F.when(labelled, F.regexp_extract("s", GAP_LABEL, 1)).alias("label"), F.when(labelled, F.regexp_extract("s", GAP_LABEL, 2)).otherwise(F.col("s")).alias("note"))
