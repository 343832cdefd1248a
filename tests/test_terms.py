"""Lookup merge, near-duplicate terms, queries, claims."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrove import schema
from lexgrove.functions import similarity
from lexgrove.operators import claims, fuzzy, lookup
from lexgrove.operators.engine import Engine

INDEX = "book_key string, book_ord int, term string, term_ord int, pages array<string>"


def terms(spark, *names):
    return spark.createDataFrame([(i, t) for i, t in enumerate(names)], "ord long, term string")


def pairs(df):
    return {(r.term1, r.term2): (r.match_type, r.score) for r in df.collect()}


def test_abbreviations(spark):
    assert pairs(fuzzy.abbreviation_pairs(terms(spark, "EEG", "Electroencephalogram (EEG)", "brain"))) == {("EEG", "Electroencephalogram (EEG)"): ("abbreviation", 1.0)}
    assert len(pairs(fuzzy.abbreviation_pairs(terms(spark, "TMS", "stimulation (TMS)", "magnetic (TMS) pulses")))) == 2


def test_case(spark):
    assert pairs(fuzzy.case_pairs(terms(spark, "Thalamus", "thalamus", "cortex"))) == {("Thalamus", "thalamus"): ("case", 1.0)}
    assert len(pairs(fuzzy.case_pairs(terms(spark, "(fMRI)", "fMRI")))) == 1


def test_containment(spark):
    assert pairs(fuzzy.containment_pairs(terms(spark, "visual working memory", "working memory"))) == {("working memory", "visual working memory"): ("containment", 0.667)}
    assert pairs(fuzzy.containment_pairs(terms(spark, "memory", "working memory"), 4)) == {("memory", "working memory"): ("containment", 0.429)}
    assert not pairs(fuzzy.containment_pairs(terms(spark, "hippocampus", "hippocampuss")))
    assert not pairs(fuzzy.containment_pairs(terms(spark, "go", "go away")))
    # only the earlier term has to be long enough
    assert not pairs(fuzzy.containment_pairs(terms(spark, "fear", "fear response")))
    assert pairs(fuzzy.containment_pairs(terms(spark, "fear response", "fear")))


def test_token_set(spark):
    found = pairs(fuzzy.token_set_pairs(terms(spark, "long-term potentiation", "potentiation long-term")))
    assert found[("long-term potentiation", "potentiation long-term")][1] >= 0.8


def test_ratio_values():
    assert similarity.ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat") == pytest.approx(92.3077, abs=1e-3)
    assert similarity.ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert similarity.ratio("", "x") == 0 and similarity.ratio(None, "x") is None


def test_ratio_kernel_bound_and_native_agree(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    rows = [(" ".join(word() for _ in range(rnd.randint(0, 4))), " ".join(word() for _ in range(rnd.randint(0, 4)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "x string, y string")
    out = df.select("x", "y", similarity.token_set_ratio("x", "y").alias("fast"), similarity.token_set_ratio_native("x", "y").alias("native"), similarity.token_set_bound("x", "y").alias("bound")).collect()
    for r in out:
        assert r.fast == pytest.approx(similarity.ratio(r.x, r.y)) == pytest.approx(r.native)
        assert r.bound >= r.fast - 1e-9


def test_lcs_against_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abé🙂") for _ in range(rnd.randint(0, 9))) for _ in "ab")
        assert similarity.lcs(a, b) == slow(a, b)


def test_all_pairs_once_and_ordered(spark):
    df = spark.createDataFrame([(0, "EEG", ["a"]), (1, "Electro EEG (EEG)", ["a", "b"]), (2, "thalamus", ["a", "b", "c"]), (3, "Thalamus", ["a"])], "ord long, term string, books array<string>")
    rows = fuzzy.ordered(fuzzy.all_pairs(df)).collect()
    assert len({frozenset((r.term1, r.term2)) for r in rows}) == len(rows)
    assert (rows[0].term1, rows[0].n_union) == ("thalamus", 3)
    assert pairs(fuzzy.all_pairs(df))[("EEG", "Electro EEG (EEG)")][0] == "abbreviation"


def index_of(spark):
    return spark.createDataFrame(
        [("book_a", 1, "Hippocampus", 1, ["12", "34"]), ("book_a", 1, "Hippocampus > in memory", 2, ["12"]), ("book_a", 1, "Amygdala", 3, ["5"]), ("book_b", 2, "Hippocampus", 1, ["99"]), ("book_b", 2, "amygdala", 2, ["7"])],
        INDEX,
    )


def test_lookup_merge(spark):
    rows = {r.term: r for r in lookup.lookup_maps(lookup.build_lookup(index_of(spark))).collect()}
    assert rows["Hippocampus"].books == ["book_a", "book_b"] and rows["Hippocampus"].pages == {"book_a": ["12", "34"], "book_b": ["99"]}
    assert rows["Hippocampus"].ord == 1 and [r.term for r in sorted(rows.values(), key=lambda r: r.ord)] == ["Hippocampus", "Amygdala", "amygdala"]
    assert "Hippocampus > in memory" not in rows
    assert lookup.build_lookup(index_of(spark), with_subentries=True).where("term LIKE '%>%'").count() == 1


@pytest.mark.parametrize(
    "entries, term, pages",
    [
        ([("memory", []), ("memory consolidation", ["10", "11"]), ("memory retrieval", ["20"])], "memory", ["10", "11", "20"]),
        ([("eeg", []), ("eeg rhythms", ["30", "31"]), ("eeg waves", ["31", "32"])], "eeg", ["30", "31", "32"]),
        ([("eeg", ["1"]), ("eeg rhythms", ["30"])], "eeg", ["1"]),
        ([("eeg", []), ("eegs", ["30"])], "eeg", []),
    ],
)
def test_fill_sub_entries(spark, entries, term, pages):
    df = spark.createDataFrame([("b", 1, t, i, p) for i, (t, p) in enumerate(entries)], INDEX)
    assert lookup.build_lookup(df).where(F.col("term") == term).first().pages == pages


def engine(spark):
    books = spark.createDataFrame([("a", "A", "Ann", 2001, None, None, None), ("b", "B", "Bob", 1999, None, None, None), ("c", "C", "Cy", 2010, None, None, None)], schema.TABLES["books"].replace(" NOT NULL", ""))
    t = spark.createDataFrame([(1, "Memory", 2), (2, "memory", 1), (3, "working memory", 1), (4, "eye", 1)], "id long, term string, n_books int")
    occ = spark.createDataFrame([(1, "a", ["1"]), (1, "b", ["2"]), (2, "a", ["3"]), (3, "b", ["4"]), (4, "a", [])], "term_id long, book_key string, pages array<string>")
    cand = spark.createDataFrame([(1, 2, "case", 1.0), (1, 3, "containment", 0.5), (2, 3, "token_set", 0.9)], "term1_id long, term2_id long, match_type string, score double")
    return Engine(books, t, occ, cand)


def test_engine(spark):
    e = engine(spark)
    hit, miss = e.lookup("Memory").first(), e.lookup("nothing").first()
    assert hit.found and hit.n_books == 2 and hit.books == ["a", "b"] and hit.pages == {"a": ["1"], "b": ["2"]}
    assert not miss.found and miss.n_books == 0 and miss.books == [] and miss.pages == {}
    assert {r.term for r in e.lookup_icase("MEMORY").collect()} == {"Memory", "memory"}
    assert [(r.term, r.match_score) for r in e.expand("Memory").collect()] == [("memory", 1.0)]
    assert [r.term for r in e.expand("Memory", 0.5).collect()] == ["memory", "working memory"]
    assert e.expand("nothing").count() == 0
    assert [(r.key, r.n_terms) for r in e.books().collect()] == [("b", 2), ("a", 3), ("c", 0)]
    assert e.stats().first().asDict() == {"books": 3, "terms": 4, "occurrences": 5, "candidates": 3, "cross_book_terms": 1}
    full = {(r.section, r.term) for r in e.full_lookup("MEMORY", min_score=0.5).collect()}
    assert full == {("icase", "Memory"), ("icase", "memory"), ("variants", "working memory")}
    assert {(r.section, r.term) for r in e.full_lookup("Memory").collect()} == {("exact", "Memory"), ("variants", "memory")}
    assert e.search("working memory").first().score == 100
    assert {r.label for r in e.labels().collect()} == {"Ann 2001", "Bob 1999", "Cy 2010"}


def test_views_and_documented_sql(spark):
    engine(spark).views()
    rows = spark.sql("SELECT t2.term, c.score FROM terms t JOIN candidates c ON t.id IN (c.term1_id, c.term2_id) JOIN terms t2 ON t2.id = CASE WHEN c.term1_id = t.id THEN c.term2_id ELSE c.term1_id END WHERE t.term = 'memory' ORDER BY c.score DESC").collect()
    assert [r.term for r in rows] == ["Memory", "working memory"]
    for name in ("books", "terms", "occurrences", "candidates"):
        spark.catalog.dropTempView(name)


def test_plans_have_no_nested_loops(spark):
    e = engine(spark)
    for df in (e.expand("Memory"), fuzzy.containment_pairs(terms(spark, "a b", "b c"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_claims(spark):
    t = spark.createDataFrame([("hippocampus", 3), ("hippocampus and memory", 1), ("cortex", 2)], "term string, n_books int")
    best = claims.match_claim("The hippocampus supports spatial memory", t).collect()
    assert best[0].term == "hippocampus" and best[0].n_books == 3 and best[0].token_overlap == 0.25 and best[0].score == 0.75
    assert claims.match_claim("", t).count() == 0 and claims.match_claim("the of and", t).count() == 0
    assert claims.match_claim("hippocampus memory cortex", t, 2).count() == 2
    batch = spark.createDataFrame([(0, "x", "hippocampus"), (1, "y", "nothing here")], "claim_ord int, label string, text string")
    out = {r.label: r.matches for r in claims.with_matches(batch, t).collect()}
    assert len(out["x"]) == 2 and out["y"] == []


def test_half_even_rounding(spark):
    t = spark.createDataFrame([("aaa", 1)], "term string, n_books int")
    text = " ".join(["aaa", *[c * 3 for c in "bcdefghijklmnop"]])  # one of sixteen: 0.0625
    assert claims.match_claim(text, t).first().token_overlap == 0.062


def test_schema_tables_and_constraints(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    schema.drop(spark, "shelf")
    schema.create(spark, "shelf")
    schema.create(spark, "shelf")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN shelf").collect()} >= set(schema.TABLES)
    e = engine(spark)
    held = {"books": e.book_rows, "terms": e.terms, "occurrences": e.occurrences, "candidates": e.candidates}
    schema.load(spark, held, "shelf")
    assert Engine.of_catalog(spark, "shelf").stats().first().terms == 4
    assert schema.violations(held).count() == 0
    bad = dict(held, terms=held["terms"].union(spark.createDataFrame([(9, "eye", 1)], "id long, term string, n_books int")), candidates=spark.createDataFrame([(1, 1, "case", 1.0), (1, 77, "case", 1.0)], held["candidates"].schema))
    assert {(r.table_name, r.rule): r.n for r in schema.violations(bad).collect()} == {("terms", "unique(term)"): 1, ("candidates", "term2_id in terms"): 1, ("candidates", "term1_id <> term2_id"): 1}
    schema.drop(spark, "shelf")
    assert spark.sql("SHOW TABLES IN shelf").where("NOT isTemporary").count() == 0


def test_registered_candidates_are_of_all_strategies(spark):
    from lexgrove.plans import term_queries as Q

    sf = "/root/testdata/sf0.001"
    pairs = sorted((min(p.ord1, p.ord2), max(p.ord1, p.ord2), p.match_type, p.score) for p in Q.all_pairs(spark, sf).collect())
    assert "token_set" in {p[2] for p in pairs}
    assert sorted(tuple(r) for r in Q.candidate_ingest(spark, sf).select("term1_id", "term2_id", "match_type", "score").collect()) == pairs
    assert Q.db_stats(spark, sf).first().candidates == len(pairs)


def near_terms(rnd, n=260):
    """Terms with parts of each other, odd brackets, and one word that most of them have."""
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5)))
    out = ["memory"]
    while len(out) < n:
        kind = rnd.random()
        base = rnd.choice(out)
        if kind < 0.35:
            out.append(f"{word()} memory {word()}{rnd.choice(('', '-' + word(), ' (' + word().upper() + ')'))}")
        elif kind < 0.6:
            out.append(rnd.choice((f"{word()} {base}", f"{base} {word()}", f"{base}s", f"{word()}{base}", base.upper(), f"({base})")))
        elif kind < 0.7:
            out.append(rnd.choice(("go", "of", "the", "a b", "", "  ", "go away", "abc", "abc de")))
        elif kind < 0.85:
            cut = sorted(rnd.randrange(len(base) + 1) for _ in "ab")
            out.append(base[cut[0] : cut[1]])
        else:
            out.append(" ".join(word() for _ in range(rnd.randint(1, 5))))
    return list(dict.fromkeys(out))


def blocked(spark, df):
    from lexgrove.functions import text as T

    return [(r.ord, r.term, r.norm, set(r.tokens)) for r in df.select("ord", "term", T.normalised("term").alias("norm"), T.block_tokens("term").alias("tokens")).collect()]


@pytest.mark.parametrize("cell", [5, 2000])
def test_pairs_against_all_pairs(spark, monkeypatch, cell):
    """Both strategies by rarest keys and cells find what trying every pair finds, each pair once."""
    monkeypatch.setattr(fuzzy, "CELL", cell)
    df = terms(spark, *near_terms(random.Random(cell)))
    rows = sorted(blocked(spark, df))
    inner, near = set(), set()
    for i, (o1, t1, n1, k1) in enumerate(rows):
        for o2, t2, n2, k2 in rows[i + 1 :]:
            if n1 == n2 or not k1 & k2:
                continue
            if len(n1) >= 6 and (n1 in n2 or n2 in n1) and round(min(len(n1), len(n2)) / max(len(n1), len(n2)), 3) < 0.95:
                inner.add((t1, t2) if len(n1) < len(n2) else (t2, t1))
            if similarity.ratio(t1, t2) >= 80:
                near.add((t1, t2))
    for found, want in ((fuzzy.containment_pairs(df), inner), (fuzzy.token_set_pairs(df), near)):
        got = [(r.term1, r.term2) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_a_hot_token_makes_few_candidates(spark):
    """A word of all terms: what lies in others is looked up at its rarest piece, and cells share the rest."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    df = terms(spark, *[f"memory {word()} {word()}" for _ in range(600)])
    every_pair = 600 * 599 // 2
    assert fuzzy.containment_candidates(df).count() < every_pair // 100
    met = fuzzy.token_candidates(df)
    assert met.count() == every_pair


def test_cells_of_a_hot_token(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "CELL", 50)
    df = terms(spark, *[f"memory x{n} y{n}" for n in range(400)])
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        parts = [r["count"] for r in fuzzy.token_candidates(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(parts) == 400 * 399 // 2 and len(parts) == 4 and max(parts) < sum(parts) * 0.6


def test_lcs_of_many():
    rnd = random.Random(9)
    text = lambda most: "".join(rnd.choice("abé🙂 ") for _ in range(rnd.randint(0, most)))
    a, b = [text(rnd.choice((3, 20, 90))) for _ in range(900)], [text(rnd.choice((3, 20, 90))) for _ in range(900)]
    assert similarity.lcs_many(a, b).tolist() == [similarity.lcs(x, y) for x, y in zip(a, b)]
    assert similarity.lcs_many([], []).tolist() == []
    assert similarity.lcs_many(["x" * 64, "x" * 65], ["x" * 64, "x" * 70]).tolist() == [64, 65]


def test_stored_lookups_read_their_parts_alone(spark, tmp_path):
    """Files of all other parts are made unreadable: lookups of one term never open them."""
    import pathlib

    from lexgrove.operators.engine import letters, part_of
    from lexgrove.plans import build

    plain = engine(spark)
    more = spark.createDataFrame([(n, f"term {n}", 1) for n in range(5, 300)], "id long, term string, n_books int")
    terms_ = plain.terms.union(more)
    occurrences = plain.occurrences.union(more.select("id", F.lit("c"), F.array(F.lit("1"))))
    candidates = plain.candidates.union(more.select("id", (F.col("id") % 7 + 100).cast("long"), F.lit("case"), F.lit(1.0)))
    folder, parts = str(tmp_path / "db"), 16
    build.store({"books": plain.book_rows, "terms": terms_, "occurrences": occurrences, "candidates": candidates}, folder, parts)
    e = build.stored(spark, folder)
    calls = [lambda e: e.lookup("Memory"), lambda e: e.lookup("nothing"), lambda e: e.lookup_icase("MEMORY"), lambda e: e.expand("Memory", 0.4), lambda e: e.full_lookup("Memory", min_score=0.4), lambda e: e.full_lookup("MEMORY", min_score=0.4), lambda e: e.full_lookup("nothing")]
    want = [sorted(map(str, call(plain).collect())) for call in calls]
    assert [sorted(map(str, call(e).collect())) for call in calls] == want
    assert e.candidates.count() == candidates.count() and e.terms.count() == 299 and e.edges().count() == 2 * candidates.count()

    of_ids = {r.p for r in terms_.where("id <= 3").select(part_of(F.col("id"), parts).alias("p")).collect()}
    of_terms = {r.p for r in spark.createDataFrame([("Memory",), ("nothing",)], "t string").select(part_of(letters("t"), parts).alias("p")).collect()}
    spoilt = 0
    for name, kept in (("terms", of_terms), ("terms_by_id", of_ids), ("occurrences", of_ids), ("edges", of_ids)):
        for part in pathlib.Path(folder, name).glob("part=*"):
            if int(part.name[5:]) not in kept:
                for file in part.glob("*.parquet"):
                    file.write_bytes(b"no parquet")
                    (part / f".{file.name}.crc").unlink(missing_ok=True)
                    spoilt += 1
    assert spoilt > 40
    e = build.stored(spark, folder)
    assert [sorted(map(str, call(e).collect())) for call in calls] == want
    with pytest.raises(Exception, match="(?i)parquet"):
        e.coverage().collect()
    plan = e.full_lookup("Memory")._jdf.queryExecution().toString()
    assert plan.count("Exchange") < 20 and len(plan) < 60_000


def test_lookups_of_more_ids_than_a_filter_takes(spark, monkeypatch):
    from lexgrove.operators import engine as E

    e = engine(spark)
    want = [sorted(map(str, e.expand("Memory", 0.4).collect())), sorted(map(str, e.lookup("Memory").collect()))]
    monkeypatch.setattr(E, "MANY", 0)
    assert sorted(map(str, e.lookup("Memory").collect())) == want[1]
    monkeypatch.setattr(E, "MANY", 1)
    assert sorted(map(str, e.expand("Memory", 0.4).collect())) == want[0]
