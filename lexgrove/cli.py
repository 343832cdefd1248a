"""Command line: python -m lexgrove.cli COMMAND ...; results as text or, with --json, as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import claims, fuzzy
from .plans import build
from .session import session
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexgrove", description=__doc__)
    p.add_argument("--db", default="relations", help="folder of the relations")
    p.add_argument("--json", action="store_true", help="JSON lines instead of text")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("lookup", help="a term, exactly or in another case; exit status 1 if there is none")
    c.add_argument("term")
    c.add_argument("--expand", action="store_true", help="with its candidates")
    c.add_argument("--score", type=int, default=60, help="least candidate score, 0 to 100")
    c = sub.add_parser("search", help="terms like a query")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("claim", help="terms for a claim")
    c.add_argument("text")
    c.add_argument("--top", type=int, default=10)
    sub.add_parser("books", help="all books")
    sub.add_parser("stats", help="counts")
    c = sub.add_parser("pairs", help="the first candidate pairs")
    c.add_argument("--threshold", type=float, default=80)
    c.add_argument("--show", type=int, default=30)
    c = sub.add_parser("build", help="relations of a registry and text files")
    c.add_argument("registry")
    c.add_argument("texts", nargs="+")
    c.add_argument("--keys", nargs="*", help="only these books")
    c.add_argument("--threshold", type=float, default=80)
    c.add_argument("--with-subentries", action="store_true")
    c.add_argument("--no-link", action="store_true", help="without chapters and references")
    c.add_argument("--markdown", help="folder for the books' markdown")
    c = sub.add_parser("detect", help="where the indices of text files begin, with their first entries")
    c.add_argument("texts", nargs="+")
    c.add_argument("--show", type=int, default=10)
    c = sub.add_parser("convert", help="PDF and EPUB files to texts, those of books that have none yet")
    c.add_argument("files", nargs="+")
    c.add_argument("--out", default="texts")
    c.add_argument("--force", action="store_true", help="convert again")
    c = sub.add_parser("list", help="books of a registry with the sizes of their texts and markdown")
    c.add_argument("registry")
    c.add_argument("--texts", nargs="*", default=[])
    c.add_argument("--markdown", nargs="*", default=[])
    c = sub.add_parser("extract", help="the books' indices as JSON")
    c.add_argument("registry")
    c.add_argument("texts", nargs="+")
    c.add_argument("--keys", nargs="*")
    c.add_argument("--out", default="indices")
    c = sub.add_parser("refs", help="chapters and references of markdown files, and the stored terms linked to them")
    c.add_argument("markdown", nargs="+")
    c.add_argument("--registry")
    c.add_argument("--out", default="references")
    c.add_argument("--no-link", action="store_true")
    return p


def _show(df: DataFrame, as_json: bool) -> int:
    """Prints the rows, which are few by the commands' limits; how many there were."""
    rows = writers.json_rows(df).collect() if as_json else df.collect()
    for r in rows:
        print(r[0] if as_json else "  ".join("" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r))
    return len(rows)


def _lookup_lines(found: DataFrame, labels: DataFrame) -> list[str]:
    """The text of a lookup: exact hits or those in another case, then the variants by score."""
    none = F.lit(None).cast("string")
    marked = found.withColumn("mark", F.when(F.col("section") == "exact", none).when(F.col("section") == "icase", "case").otherwise(F.coalesce("match_type", F.lit("~"))))
    rows = marked.select("section", "term", "mark", "match_score").collect()
    text = {(r.term, r.mark): r.text for r in writers.hit_lines(marked, labels).collect()}
    order = sorted(rows, key=lambda r: (-(r.match_score or 0), r.term))
    own, near = ([text[r.term, r.mark] for r in order if (r.section == "variants") is kind] for kind in (False, True))
    return (own or ["  (not found)"]) + ([f"\n  variants ({len(near)}):", *near] if near else [])


def _claim_lines(text: str, matches: DataFrame, occurrences: DataFrame, terms: DataFrame, labels: DataFrame) -> list[str]:
    """The text of a claim's matches: score, term, one of its books and how many more it has."""
    held = matches.join(terms.select("id", "term"), "term").join(occurrences, F.col("id") == F.col("term_id")).join(labels, F.col("book_key") == F.col("key"), "left")
    first = held.groupBy("place", "term", "score", "n_books").agg(F.min_by(F.coalesce("label", "book_key"), "book_key").alias("book")).orderBy("place").collect()
    more = lambda r: f" + {r.n_books - 1} more" if r.n_books > 1 else ""
    return [f"claim: {text!r}", *([f"  [{r.score:.2f}]  {r.term:<45}  {r.book}{more(r)}" for r in first] or ["  (no matches)"])]


def _prepare(args: argparse.Namespace, spark) -> int | None:
    """The commands that read files; None for others."""
    if args.command == "detect":
        from .operators.index import index_start

        lines = readers.lines(readers.texts(spark, args.texts))
        start = index_start(lines)
        _show(start, args.json)
        near = lines.join(start, "book_key").where(F.col("line_no").between(F.col("start_line") - 1, F.col("start_line") - 2 + args.show))
        _show(near.orderBy("book_key", "line_no").select("book_key", (F.col("line_no") + 1).alias("line"), "raw"), args.json)
        return 0
    if args.command == "convert":
        pdf, epub = ([f for f in args.files if f.lower().endswith(e)] for e in (".pdf", ".epub"))
        for texts in ([readers.pdf_texts(spark, pdf)] if pdf else []) + ([readers.epub_text(readers.epub_documents(spark, epub))] if epub else []):
            writers.text_files(texts, args.out, args.force)
        for r in readers.epub_problems(spark, epub).collect() if epub else []:
            print(f"  [{r.book_key}] skipped: {r.problem}", file=sys.stderr)
        return 0
    if args.command == "list":
        rows = readers.registry(spark, args.registry).select("book_key")
        for name, files in (("text", args.texts), ("md", args.markdown)):
            held = [readers.sizes(spark, f).select("book_key", F.floor(F.col("n_bytes") / 1024).alias(name)) for f in files]
            sizes = held[0] if held else rows.limit(0).select("book_key", F.lit(None).cast("long").alias(name))
            for more in held[1:]:
                sizes = sizes.union(more)
            rows = rows.join(sizes, "book_key", "left")
        _show(rows.orderBy("book_key"), args.json)
        return 0
    if args.command == "extract":
        registry = readers.registry(spark, args.registry, args.keys)
        rows = build.extract_index(readers.texts(spark, args.texts), registry)
        writers.by_book(rows.select("book_key", "term", "term_ord", "pages"), args.out, "json")
        return 0
    if args.command == "refs":
        from .operators import chapters as C

        registry = readers.registry(spark, args.registry) if args.registry else None
        linked = build.extract_references(readers.texts(spark, args.markdown).withColumnRenamed("text", "markdown"), registry)
        for name, df in linked.items():
            writers.by_book(df, f"{args.out}/{name}")
        held = {name: spark.read.parquet(f"{args.out}/{name}") for name in linked}
        _show(C.totals(held["chapters"], held["references"]).select("book_key", "n_chapters", "n_references"), args.json)
        if not args.no_link:
            engine = build.stored(spark, args.db)
            lookup = engine.occurrences.join(engine.terms, F.col("term_id") == F.col("id")).select("term", "book_key", "pages")
            writers.whole(C.link_all(lookup, held["chapters"], held["references"]), f"{args.out}/lookup")
            _show(C.linked_totals(engine.terms.select("term"), C.link_chapters(lookup, held["chapters"])).select("n_linked", "n_terms"), args.json)
        return 0
    return None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("lexgrove-cli")
    done = _prepare(args, spark)
    if done is not None:
        return done
    if args.command == "build":
        registry = readers.registry(spark, args.registry, args.keys)
        texts = readers.texts(spark, args.texts)
        rows = build.with_book_order(build.extract_index(texts, registry), registry)
        linked = None
        if not args.no_link or args.markdown:
            markdown = build.text_to_markdown(texts, registry).persist()
            if args.markdown:
                writers.markdown_files(markdown, args.markdown)
            if not args.no_link:
                linked = build.extract_references(markdown, registry)
        build.store(build.relations(rows, registry, args.threshold, args.with_subentries, linked), args.db)
        return 0
    engine = build.stored(spark, args.db)
    if args.command == "lookup":
        found = engine.full_lookup(args.term, args.expand, args.score / 100)
        if args.json:
            return 0 if _show(found, True) else 1
        lines = _lookup_lines(found, engine.labels())
        print("\n".join(lines))
        return 1 if lines == ["  (not found)"] else 0
    if args.command == "search":
        _show(engine.search(args.query, args.limit).select("score", "term", "n_books", "books"), args.json)
    elif args.command == "claim":
        matches = claims.match_claim(args.text, engine.terms, args.top)
        if args.json:
            return 0 if _show(matches.select("score", "term", "n_books", "token_overlap"), True) else 1
        lines = _claim_lines(args.text, matches, engine.occurrences, engine.terms, engine.labels())
        print("\n".join(lines))
        return 1 if lines[1:] == ["  (no matches)"] else 0
    elif args.command == "pairs":
        terms = engine.terms.withColumnRenamed("id", "ord").join(engine.occurrences.groupBy(F.col("term_id").alias("ord")).agg(F.collect_list("book_key").alias("books")), "ord")
        _show(fuzzy.ordered(fuzzy.all_pairs(terms, args.threshold)).limit(args.show).select("n_union", "score", "match_type", "term1", "term2"), args.json)
    else:
        _show(engine.books() if args.command == "books" else engine.stats(), args.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
