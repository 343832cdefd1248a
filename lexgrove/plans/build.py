"""The build: texts to indices, lookup, candidates, relations, markdown, chapters and linked references.

Every step takes and returns DataFrames; `store` writes what the query engine reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chapters as C
from ..operators import fuzzy, index, lookup, pages
from ..operators.engine import Engine, both_directions, letters, part_of
from ..operators.hooks import Hooks
from ..sources import readers

NO_HOOKS = Hooks()


def extract_index(texts: DataFrame, registry: DataFrame, hooks: Hooks = NO_HOOKS) -> DataFrame:
    """texts (book_key, text) and registry -> index rows; the start line is the registry's, else the detected one."""
    lines = readers.lines(texts)
    asked = registry.select("book_key", "index_start_line", F.coalesce("subentry_strategy", F.lit("capitalize")).alias("strategy"))
    start = index.index_start(lines).join(asked, "book_key", "full").select("book_key", F.coalesce("index_start_line", "start_line").alias("start"), F.coalesce("strategy", F.lit("capitalize")).alias("strategy"))
    inside = lines.join(start, "book_key").where("line_no >= start - 1")
    parsed = [index.parse_index(inside.where(F.col("strategy") == s).select("book_key", "line_no", "raw"), s) for s in ("capitalize", "indent_only")]
    return hooks.apply("post_index_parse", parsed[0].union(parsed[1]), registry=registry)


def with_book_order(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Index rows with each book's place in the registry (by year and key, where it has no place of its own)."""
    from ..functions.ranking import numbered

    if "book_ord" not in registry.columns:
        registry = numbered(registry.select("book_key", "year"), [(F.col("year"), False), (F.col("book_key"), False)], "book_ord")
    return rows.join(registry.select("book_key", "book_ord"), "book_key")


def text_to_markdown(texts: DataFrame, registry: DataFrame, hooks: Hooks = NO_HOOKS) -> DataFrame:
    """texts and registry -> book_key, markdown, with headers stripped by each book's shares."""
    own = {"registry": registry}
    segments = hooks.apply("post_segment", pages.segment(texts), **own).where("book_page IS NOT NULL")
    tuned = registry.select("book_key", "header_stripper.*") if "header_stripper" in registry.columns else None
    stripped = pages.strip_headers(segments, None if tuned is None else pages.bad_lines_by_book(segments, tuned))
    stripped = hooks.apply("post_strip", stripped, **own)
    annotated = hooks.apply("post_annotate", pages.annotate(stripped), **own)
    return pages.markdown(annotated, registry)


def extract_references(markdown: DataFrame, registry: DataFrame | None = None, hooks: Hooks = NO_HOOKS) -> dict[str, DataFrame]:
    """book_key, markdown -> markers, chapters and references of every book."""
    lines = C.markdown_lines(markdown)
    markers = hooks.apply("post_page_map", C.page_markers(lines))
    if registry is not None and "ref_heading_pattern" in registry.columns:
        own = registry.select("book_key", "ref_heading_pattern")
        opens = F.rlike("line", F.coalesce("ref_heading_pattern", F.lit(C.REFERENCES)))
        found = C.detect(lines.join(own, "book_key", "left").withColumn("opens", opens).drop("ref_heading_pattern"), F.col("opens"))
    else:
        found = C.detect(lines)
    found = hooks.apply("post_chapter_detect", found, lines=lines, markers=markers)
    refs = hooks.apply("post_ref_parse", C.references(lines, found), lines=lines, chapters=found)
    return {"markers": markers, "chapters": found, "references": refs}


def relations(rows: DataFrame, registry: DataFrame, threshold: float = 80, with_subentries: bool = False, linked: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Index rows (with book_ord) and registry -> all relations; chapters, references and their links where given."""
    merged = lookup.build_lookup(rows, with_subentries)
    pairs = fuzzy.all_pairs(lookup.lookup_maps(merged).select("ord", "term", "books"), threshold)
    none = F.lit(None).cast("string")
    path = F.coalesce(F.nullif("pdf", F.lit("")), "epub_path")
    books = registry.select(F.col("book_key").alias("key"), "title", "author", "year", path.alias("pdf_path"), F.col("text").alias("text_path"), none.alias("md_path"))
    out = lookup.relations(merged, pairs, books)
    if linked:
        ids = linked["chapters"].withColumn("id", F.xxhash64("book_key", "ch_ord"))
        title = C.T.chapter_title("title", "start_page", "end_page")
        out["chapters"] = ids.select("id", "book_key", title.alias("title"), F.col("start_page").alias("start_book_page"), F.col("end_page").alias("end_book_page"), F.col("ref_start_line").alias("ref_line"))
        out["references"] = linked["references"].select(F.xxhash64("book_key", "ch_ord", "ref_ord").alias("id"), F.xxhash64("book_key", "ch_ord").alias("chapter_id"), "authors", F.col("year").try_cast("int").alias("year"), "title", "venue", "raw")
        links = C.link_chapters(merged, linked["chapters"])
        out["term_chapters"] = links.join(out["terms"].select(F.col("id").alias("term_id"), "term"), "term").select("term_id", F.xxhash64("book_key", "ch_ord").alias("chapter_id"))
    return out


#: Parts of a stored relation, unless asked for otherwise; large ones take thousands.
PARTS = 16


#: The relations that lie in parts, by what lookups ask for.
LAID = ("terms", "terms_by_id", "occurrences", "edges")


def store_laid(name: str, relations: dict[str, DataFrame], folder: str, parts: int = PARTS) -> None:
    """One of LAID in its folder: a folder of each part (column part), a file each and sorted within.

    terms lie by their letters, terms_by_id and occurrences by id, candidates from both ends
    by the id they start at, so that a lookup reads the folders of its keys and, in them, the
    row groups of its keys.
    """
    if name in ("terms", "terms_by_id"):
        df = relations["terms"].withColumn("n_books", F.col("n_books").cast("int"))
        key, order = (letters("term"), ["term"]) if name == "terms" else (F.col("id"), ["id"])
    elif name == "occurrences":
        df, key, order = relations[name], F.col("term_id"), ["term_id", "book_key"]
    else:
        df, key, order = both_directions(relations["candidates"]), F.col("src"), ["src", "dst"]
    dealt = df.withColumn("part", part_of(key, parts)).repartition(parts, "part").sortWithinPartitions("part", *order)
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")


def store(relations: dict[str, DataFrame], folder: str, parts: int = PARTS) -> None:
    """Each relation as Parquet below the folder, those that lookups read in parts."""
    spark = next(iter(relations.values())).sparkSession
    for name in LAID:
        store_laid(name, relations, folder, parts)
    for name, df in relations.items():
        if name not in LAID and name != "candidates":
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{folder}/layout")


def laid(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of LAID as it was stored."""
    schema = {
        "terms": "id long, term string, n_books int, part int",
        "terms_by_id": "id long, term string, n_books int, part int",
        "occurrences": "term_id long, book_key string, pages array<string>, part int",
        "edges": "src long, dst long, match_type string, score double, forward boolean, part int",
    }[name]
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def over(books: DataFrame | None, held: dict[str, DataFrame], parts: int) -> Engine:
    """The engine over stored relations; one that was left out serves no query that needs it."""
    edges = held.get("edges")
    candidates = None if edges is None else edges.where("forward").select(F.col("src").alias("term1_id"), F.col("dst").alias("term2_id"), "match_type", "score")
    return Engine(books, held.get("terms"), held.get("occurrences"), candidates, held.get("terms_by_id"), edges, parts)


def stored(spark: SparkSession, folder: str) -> Engine:
    """The engine over what `store` wrote."""
    held = {name: laid(spark, folder, name) for name in LAID}
    return over(spark.read.parquet(f"{folder}/books"), held, spark.read.parquet(f"{folder}/layout").first().parts)
