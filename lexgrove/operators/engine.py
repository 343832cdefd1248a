"""The query engine over the relations books, terms, occurrences and candidates.

Relations may be any DataFrames.  Stored ones (plans/build.py) are dealt to parts by what
lookups ask for: a term's letters, or an id.  A lookup first finds its terms' ids, a handful
of rows of one part, and then reads the parts of these ids alone; what has more ids than
MANY is joined instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fuzzy import search as fuzzy_search

HIT = "term string, found boolean, n_books bigint, books array<string>, pages map<string,array<string>>"


#: Ids that go into a filter; more of them are joined.
MANY = 2000


def part_of(key: Column, parts: int) -> Column:
    """The part in which the rows of a key lie."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def letters(term: Column | str) -> Column:
    """What spellings of a term that differ in the case of A-Z have in common."""
    return T.ascii_lower(term)


class Engine:
    """Lookups, expansion and reports as DataFrames; those of single terms read the terms' ids first.

    terms_by_id and edges (candidates in both directions: src, dst, match_type, score,
    forward) are the same rows in the layout of an id; parts is the number of parts of
    stored relations, which have a column `part`.
    """

    def __init__(self, books: DataFrame | None, terms: DataFrame | None, occurrences: DataFrame | None, candidates: DataFrame | None, terms_by_id: DataFrame | None = None, edges: DataFrame | None = None, parts: int | None = None):
        self.book_rows, self.terms, self.occurrences, self.candidates = books, terms, occurrences, candidates
        self.terms_by_id, self._edges, self.parts = terms if terms_by_id is None else terms_by_id, edges, parts

    @classmethod
    def of_catalog(cls, spark: SparkSession, database: str = "default") -> "Engine":
        return cls(*[spark.table(f"{database}.{t}") for t in ("books", "terms", "occurrences", "candidates")])

    def views(self) -> None:
        """Temporary views under the relations' names, for SQL of one's own."""
        for name, df in (("books", self.book_rows), ("terms", self.terms), ("occurrences", self.occurrences), ("candidates", self.candidates)):
            df.createOrReplaceTempView(name)

    def _of_ids(self, df: DataFrame, key: str, ids: list[int]) -> DataFrame:
        """The rows of some ids, from their parts alone."""
        rows = df.where(F.col(key).isin(ids) if ids else F.lit(False))
        if self.parts is not None:
            rows = rows.where(F.col("part").isin(self._parts_of(ids)))
        return rows

    def _parts_of(self, ids: list[int]) -> list[int]:
        spark = self.terms.sparkSession
        told = F.transform(F.array(*[F.lit(i).cast("long") for i in ids]), lambda i: part_of(i, self.parts))
        return sorted(set(spark.range(1).select(told.alias("p")).first().p)) if ids else []

    def _ids(self, df: DataFrame, key: str = "id") -> list[int] | None:
        """The distinct ids of a few rows; None where there are more than MANY."""
        got = [r[0] for r in df.select(key).distinct().limit(MANY + 1).collect()]
        return got if len(got) <= MANY else None

    def _held(self, df: DataFrame, key: str, ids: list[int] | None) -> DataFrame:
        return df if ids is None else self._of_ids(df, key, ids)

    def hydrated(self, terms: DataFrame, ids: list[int] | None = None) -> DataFrame:
        """terms (id, term, n_books and more) with their books and pages, in one join; equal rows become one.

        ids, if given, are those of the terms: only their parts are read.
        """
        held = self._held(self.occurrences, "term_id", ids).select(F.col("term_id").alias("_term_id"), F.struct("book_key", "pages").alias("_entry"))
        joined = terms.join(held, terms["id"] == held["_term_id"], "left").drop("_term_id")
        packed = joined.groupBy(*terms.columns).agg(F.array_sort(F.collect_set("_entry")).alias("_e"))
        return packed.withColumn("books", F.transform("_e", lambda x: x["book_key"])).withColumn("pages", F.map_from_entries("_e")).drop("_e")

    def _asked(self, term: str) -> DataFrame:
        return self.terms.sparkSession.range(1).select(F.lit(term).alias("asked"))

    def _spelt(self, term: str) -> DataFrame:
        """id, term, n_books of all spellings of a term, from their one part."""
        own = self.terms.where(letters("term") == letters(F.lit(term)))
        if self.parts is not None:
            own = own.where(F.col("part") == part_of(letters(F.lit(term)), self.parts))
        return own.select("id", "term", "n_books")

    def lookup(self, term: str) -> DataFrame:
        """The exact term: one row even if it is unknown (found false, nothing in it)."""
        own = self._spelt(term).where(F.col("term") == term)
        hit = self.hydrated(own, self._ids(own))
        row = self._asked(term).join(hit, F.col("asked") == F.col("term"), "left")
        return row.select(
            F.col("asked").alias("term"),
            F.col("id").isNotNull().alias("found"),
            F.coalesce(F.col("n_books").cast("long"), F.lit(0)).alias("n_books"),
            F.coalesce("books", F.array().cast("array<string>")).alias("books"),
            F.coalesce("pages", F.from_json(F.lit("{}"), "map<string,array<string>>")).alias("pages"),
        )

    def lookup_icase(self, term: str) -> DataFrame:
        """Terms equal but for the case of A-Z."""
        own = self._spelt(term)
        return self.hydrated(own, self._ids(own)).select("term", F.lit(True).alias("found"), F.col("n_books").cast("long").alias("n_books"), "books", "pages")

    def edges(self) -> DataFrame:
        """Candidates in both directions: src, dst, match_type, score."""
        if self._edges is not None:
            return self._edges
        return both_directions(self.candidates)

    def _near(self, own: list[tuple[int, int]], min_score: float) -> DataFrame:
        """own (id, position) -> one row for each edge from them to another term: id, position, match_type, score."""
        places = self.terms.sparkSession.createDataFrame(own, "src long, position long")
        near = self._of_ids(self.edges(), "src", [i for i, _ in own]).where((F.col("score") >= min_score) & (F.col("src") != F.col("dst"))).join(F.broadcast(places), "src")
        return near.select(F.col("dst").alias("id"), "position", "match_type", "score")

    def _named(self, rows: DataFrame, ids: list[int] | None) -> DataFrame:
        """rows (id and more) with their terms."""
        return rows.join(self._held(self.terms_by_id, "id", ids).select("id", "term", "n_books"), "id")

    def expand(self, term: str, min_score: float = 0.6) -> DataFrame:
        """The candidates of a term, best first; nothing for an unknown term."""
        own = [(i, 0) for i in self._ids(self._spelt(term).where(F.col("term") == term)) or []]
        near = self._near(own, min_score)
        ids = self._ids(near)
        hits = self.hydrated(self._named(near, ids), ids)
        return hits.select("term", F.lit(True).alias("found"), F.col("n_books").cast("long").alias("n_books"), "books", "pages", "match_type", F.col("score").alias("match_score")).orderBy(F.desc("match_score"), "term", "match_type")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """The terms with the highest token-set ratio to a query, 50 at least."""
        found = fuzzy_search(self.terms.select("id", "term", "n_books"), query, limit)
        return self.hydrated(found).select("term", F.lit(True).alias("found"), F.col("n_books").cast("long").alias("n_books"), "books", "pages", "score").orderBy(F.desc("score"), "term")

    def full_lookup(self, term: str, expand_results: bool = True, min_score: float = 0.6) -> DataFrame:
        """Sections exact, icase (only if exact misses) and variants (each term once, icase hits left out)."""
        spelt = self._spelt(term).select("id", "term").limit(MANY + 1).collect()
        if len(spelt) > MANY:
            raise ValueError(f"more than {MANY} spellings of one term")
        exact = [r.id for r in spelt if r.term == term]
        own = sorted(exact or [r.id for r in spelt])
        spark = self.terms.sparkSession
        section = "exact" if exact else "icase"
        wanted = spark.createDataFrame([(i, section, None, None) for i in own], "id long, section string, match_type string, match_score double")
        ids: list[int] | None = own
        if expand_results:
            near = self._near([(i, i) for i in own], min_score).where(~F.col("id").isin(own) if own else F.lit(True))
            best = near.groupBy("id").agg(F.min_by(F.struct("match_type", "score"), F.struct("position", -F.col("score"), "match_type")).alias("b"))
            variants = self._ids(near)
            ids = None if variants is None else sorted({*own, *variants})
            wanted = wanted.union(best.select("id", F.lit("variants"), "b.match_type", F.col("b.score").cast("double")))
        hits = self.hydrated(self._named(wanted, ids), ids)
        return hits.select("section", "term", F.col("n_books").cast("long").alias("n_books"), "books", "pages", "match_type", "match_score")

    def books(self) -> DataFrame:
        """Every book with its number of terms, by year."""
        counted = self.occurrences.groupBy("book_key").agg(F.count("*").alias("n"))
        return self.book_rows.join(counted, F.col("key") == F.col("book_key"), "left").select("key", "title", "author", "year", F.coalesce("n", F.lit(0)).alias("n_terms")).orderBy("year", "key")

    def stats(self) -> DataFrame:
        """One row of counts."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        terms = self.terms.agg(F.count("*").alias("terms"), F.count_if(F.col("n_books") > 1).alias("cross_book_terms"))
        one = count(self.book_rows, "books").join(terms).join(count(self.occurrences, "occurrences")).join(count(self.candidates, "candidates"))
        return one.select("books", "terms", "occurrences", "candidates", "cross_book_terms")

    def coverage(self) -> DataFrame:
        """Every term with the books it is in."""
        packed = self.occurrences.groupBy("term_id").agg(F.countDistinct("book_key").alias("n_books"), F.array_join(F.array_sort(F.collect_set("book_key")), ", ").alias("books"))
        return packed.join(self.terms.select("id", "term"), F.col("term_id") == F.col("id")).select("term", "n_books", "books")

    def labels(self) -> DataFrame:
        """A short name for each book: author and year, or its key."""
        named = F.concat_ws(" ", F.nullif("author", F.lit("")), F.col("year").cast("string"))
        return self.book_rows.select("key", F.coalesce(F.nullif(named, F.lit("")), F.col("key")).alias("label"))


def both_directions(candidates: DataFrame) -> DataFrame:
    """src, dst, match_type, score and forward: each candidate from either end; forward is the one with the smaller id first."""
    ends = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(f).alias("forward")) for a, b, f in (("term1_id", "term2_id", True), ("term2_id", "term1_id", False))])
    return candidates.select("match_type", "score", F.explode(ends).alias("e")).select("e.src", "e.dst", "match_type", "score", "e.forward")
