"""Readers, writers, hooks, argument maps, the build and the command line."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexgrove import cli
from lexgrove.functions import ranking, text
from lexgrove.operators import claims
from lexgrove.operators.hooks import Hooks, rows_hook
from lexgrove.plans import build
from lexgrove.sources import readers, writers
from lexgrove.streaming import indices

AMAP = """↓ ? one (T) "first"
↓ ~ two (E) "second" [A 2001; B 2002; ]
↓ * three (R) "third" [C 1999]
↓ ✓ four (!) "fourth"
↓ five (T) "fifth"
↓ *? six (T) "sixth"
not a claim

CITATIONS
  one  (R): Nagel1974, Chalmers1995
  two  (E): Crick1998
end of block
  three (R): Late2000

## Gap report
```
STRUCTURAL GAPS
G1 first gap
not one
G2 second gap
NAKED ASSERTIONS
naked_label (T) — needs a source
───
STUBS
stub_label (E) - to do
```
"""


def test_amap(spark):
    lines = claims.amap_lines(spark.createDataFrame([("f", AMAP)], "file string, text string"))
    found = claims.parse_claims(lines).orderBy("claim_ord").collect()
    assert [r.status for r in found] == ["?", "~", "*", "✓", "", "*?"] and [r.type for r in found] == ["T", "E", "R", "!", "T", "T"]
    assert found[1].citations == ["A 2001", "B 2002"] and found[0].citations == []
    assert [r.label for r in claims.priority_claims(claims.parse_claims(lines)).orderBy("priority").collect()] == ["one", "two"]
    assert {r.label: r.refs for r in claims.citations_block(lines).collect()} == {"one": ["Nagel1974", "Chalmers1995"], "two": ["Crick1998"]}
    gaps = claims.gap_report(lines).orderBy("line_no").collect()
    assert [(r.section, r.label) for r in gaps] == [("structural", None), ("structural", None), ("naked_assertions", "naked_label"), ("stubs", "stub_label")]
    assert gaps[0].note == "G1 first gap" and gaps[2].note == "needs a source"


def test_hooks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "book_key string, n int")
    h = Hooks()
    assert h.apply("post_segment", df) is df
    h.register("a", "post_segment", rows_hook(lambda rows, meta: [{**r, "n": r["n"] + meta["by"]} for r in rows if r["n"] > 1], {"by": 10}, "n"))
    h.register("b", "post_segment", lambda d, **t: d.withColumn("n", F.col("n") * 2))
    assert {(r.book_key, r.n) for r in h.apply("post_segment", df).collect()} == {("a", 12), ("b", 6)}
    with pytest.raises(ValueError):
        h.register("a", "no_stage", lambda d: d)


def test_ranking_and_sql_functions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rows = ranking.numbered(df, [(F.col("k"), True)]).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.ord)] == [r.id for r in sorted(rows, key=lambda r: -r.k)] and {r.ord for r in rows} == set(range(1, 1001))
    text.register(spark)
    r = spark.sql("SELECT token_set_ratio('a b', 'b a') AS a, normalise_term('(EEG) ') AS b, significant_tokens('the Long-term memory') AS c, extract_pages('x, 12f') AS d").first()
    assert (r.a, r.b, r.c, r.d) == (100.0, "eeg", ["long", "term", "memory"], ["12f"])


@pytest.fixture
def shelf(tmp_path):
    page = lambda n, *x: "\n".join([str(n), *x])
    for key, word in (("one", "Thalamus"), ("two", "thalamus")):
        body = [page(n, "", "Memory Systems Of The Brain", "", f"Words about {word} on this page.") for n in range(1, 6)]
        refs = page(6, "", "References", "", "Smith, J. (2001). A title. Journal, 3.")
        index = "Index\n\n" + "\n".join([f"{word}, 2, 3", "Memory", "  of faces, 4", "EEG, 5", "Electroencephalogram (EEG), 1"])
        (tmp_path / f"{key}.txt").write_text("\f".join([*body, refs, index]))
    registry = {k: {"title": k.title(), "author": "A", "year": 2000 + i, "pdf": "", "epub_path": f"{k}.epub", "text": f"{k}.txt"} for i, k in enumerate(("one", "two"))}
    for k in registry:
        lines = (tmp_path / f"{k}.txt").read_text().split("\n")
        registry[k]["index_start_line"] = next(i for i, x in enumerate(lines) if x.endswith("Index")) + 2
    (tmp_path / "registry.json").write_text(json.dumps(registry, indent=1))
    return tmp_path


def test_build_and_command_line(spark, shelf, capsys):
    db = str(shelf / "db")
    assert cli.main(["--db", db, "build", str(shelf / "registry.json"), str(shelf / "one.txt"), str(shelf / "two.txt"), "--markdown", str(shelf / "md")]) == 0
    engine = build.stored(spark, db)
    assert {r.term for r in engine.terms.collect()} >= {"Thalamus", "thalamus", "Memory", "EEG", "Electroencephalogram (EEG)"}
    assert spark.read.parquet(f"{db}/chapters").count() == 2 and spark.read.parquet(f"{db}/references").count() == 2
    assert spark.read.parquet(f"{db}/term_chapters").count() > 0
    capsys.readouterr()
    assert cli.main(["--db", db, "--json", "lookup", "Thalamus", "--expand"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {(r["section"], r["term"]) for r in out} == {("exact", "Thalamus"), ("variants", "thalamus")}
    assert cli.main(["--db", db, "lookup", "nothing at all"]) == 1
    for command in (["search", "thalamus"], ["books"], ["stats"], ["pairs"]):
        assert cli.main(["--db", db, *command]) == 0
    assert "Thalamus" in capsys.readouterr().out
    assert cli.main(["--db", db, "lookup", "THALAMUS", "--expand"]) == 0
    out = capsys.readouterr().out
    assert "  [case] Thalamus  (1 book)\n" + " " * 6 + f"{'A 2000':<30}  pp. 2, 3" in out and "  [case] thalamus  (1 book)\n" + " " * 6 + f"{'A 2001':<30}  pp. 2, 3" in out
    assert cli.main(["--db", db, "lookup", "EEG", "--expand"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "  EEG  (2 books)" and "  variants (1):" in out and "  [abbreviation] Electroencephalogram (EEG)  (2 books)" in out
    assert cli.main(["--db", db, "claim", "an EEG shows it"]) == 0
    assert f"  [1.00]  {'EEG':<45}  A 2000 + 1 more" in capsys.readouterr().out.splitlines()
    assert cli.main(["--db", db, "claim", "of nothing"]) == 1 and "(no matches)" in capsys.readouterr().out


def test_single_steps_of_the_command_line(spark, shelf, capsys):
    import zipfile

    db, registry, texts = str(shelf / "db"), str(shelf / "registry.json"), [str(shelf / "one.txt"), str(shelf / "two.txt")]
    assert cli.main(["detect", *texts, "--show", "4"]) == 0
    assert "Thalamus, 2, 3" in capsys.readouterr().out
    assert cli.main(["extract", registry, *texts, "--out", str(shelf / "indices")]) == 0
    assert {(r.book_key, r.term) for r in spark.read.json(str(shelf / "indices")).collect()} >= {("one", "Thalamus"), ("two", "thalamus"), ("two", "EEG")}
    assert cli.main(["--db", db, "build", registry, *texts, "--no-link", "--markdown", str(shelf / "md")]) == 0
    for key in ("one", "two"):
        whole = "\n".join(r.value for r in spark.read.text(str(shelf / "md" / f"book_key={key}")).collect())
        (shelf / f"{key}.md").write_text(whole)
    capsys.readouterr()
    assert cli.main(["list", registry, "--texts", *texts, "--markdown", str(shelf / "one.md")]) == 0
    assert [x.split() for x in capsys.readouterr().out.splitlines()] == [["one", "0", "0"], ["two", "0"]]
    assert cli.main(["--db", db, "refs", str(shelf / "one.md"), str(shelf / "two.md"), "--registry", registry, "--out", str(shelf / "refs")]) == 0
    out = capsys.readouterr().out.splitlines()
    assert sorted(out[:2]) == ["one  1  1", "two  1  1"] and out[2].split()[0] != "0"
    assert spark.read.parquet(str(shelf / "refs" / "references")).count() == 2 and spark.read.parquet(str(shelf / "refs" / "lookup")).where("size(chapters) > 0").count() > 0
    with zipfile.ZipFile(shelf / "three.epub", "w") as z:
        z.writestr("a.xhtml", "<p>One</p><p>Two</p>")
        z.writestr("b_Index.xhtml", "<p class='level1'>Term, 3</p>")
        z.writestr("c.xhtml", "<p>Three</p><style>no</style>")
    out = str(shelf / "converted")
    assert cli.main(["convert", str(shelf / "three.epub"), "--out", out]) == 0
    first = spark.read.text(out).inputFiles()
    assert [r.value for r in spark.read.text(f"{out}/book_key=three", wholetext=True).collect()] == ["One\nTwo\fThree\n"]
    assert cli.main(["convert", str(shelf / "three.epub"), "--out", out]) == 0 and spark.read.text(out).inputFiles() == first
    assert cli.main(["convert", str(shelf / "three.epub"), "--out", out, "--force"]) == 0 and spark.read.text(out).inputFiles() != first


def test_wrappers():
    import pathlib
    import subprocess

    root = pathlib.Path(__file__).parent.parent / "bin"
    for name, words in (("tl", "lookup"), ("ts", "search"), ("tc", "claim"), ("txdb", "")):
        done = subprocess.run(["bash", str(root / name), "--help"], capture_output=True, text=True)
        assert done.returncode == 0 and f"usage: lexgrove {words}".strip() in done.stdout


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Term": ["1", "2f"], "Other": []}))
    rows = readers.indices(spark, str(tmp_path / "a.json")).orderBy("term_ord").collect()
    assert [(r.book_key, r.term, r.pages) for r in rows] == [("a", "Term", ["1", "2f"]), ("a", "Other", [])]
    (tmp_path / "t.json").write_text(json.dumps([{"title": "One", "start_page": 3}, {"level": 1, "title": "Two", "pdf_page": 9}]))
    assert [(r.level, r.title, r.start_page) for r in readers.toc(spark, str(tmp_path / "t.json")).orderBy("toc_ord").collect()] == [(0, "One", 3), (1, "Two", 9)]
    (tmp_path / "b.bm").write_text("Part/1,Black,x\n\tChapter 1/15,Black\nnoise\n")
    assert [(r.level, r.title, r.start_page) for r in readers.bookmarks(spark, str(tmp_path / "b.bm")).orderBy("toc_ord").collect()] == [(0, "Part", 1), (1, "Chapter 1", 15)]
    assert readers.sizes(spark, str(tmp_path / "b.bm")).first().n_bytes == (tmp_path / "b.bm").stat().st_size
    (tmp_path / "x y.pdf").write_bytes(b"%PDF-1.4")
    assert readers.pdf_texts(spark, str(tmp_path / "x y.pdf"), "no-such-program").first().asDict() == {"book_key": "x_y", "text": None}
    writers.by_book(readers.indices(spark, str(tmp_path / "a.json")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    writers.lookup_json(spark.createDataFrame([(1, "t", 1, ["a"], {"a": ["1"]})], "ord int, term string, n_books int, books array<string>, pages map<string,array<string>>"), str(tmp_path / "lookup"))
    assert json.loads(spark.read.text(str(tmp_path / "lookup")).first().value)["pages"] == {"a": ["1"]}


def test_what_cannot_be_read_is_told(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"Term": ["1"]}))
    (tmp_path / "b.json").write_text('{"Term": ["1"')
    (tmp_path / "e.json").write_text("")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("c",)], "book_key string")
    files = readers.texts(spark, str(tmp_path / "*.json"))
    assert {(r.book_key, r.problem) for r in readers.problems(files, asked).collect()} == {("b", "malformed"), ("c", "missing"), ("e", "missing")}
    assert [r.book_key for r in readers.index_rows(files).collect()] == ["a"]
    good = tmp_path / "good.epub"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a.xhtml", "<p>a</p>")
    data = good.read_bytes()
    (tmp_path / "cut.epub").write_bytes(data[:40])
    (tmp_path / "empty.epub").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "package.epub", "w") as z:
        z.writestr("c.opf", "<package")
        z.writestr("a.xhtml", "<p>a</p>")
    (tmp_path / "flipped.epub").write_bytes(data.replace(b"<p>a</p>", b"<p>b</p>"))
    folder = str(tmp_path / "*.epub")
    assert [(r.book_key, r.name) for r in readers.epub_documents(spark, folder).collect()] == [("good", "a.xhtml")]
    assert {r.book_key: r.problem for r in readers.epub_problems(spark, folder).collect()} == {"cut": "BadZipFile", "package": "ParseError", "flipped": "BadZipFile"}
    assert cli.main(["convert", str(good), str(tmp_path / "cut.epub"), "--out", str(tmp_path / "texts")]) == 0
    assert "[cut] skipped: BadZipFile" in capsys.readouterr().err
    assert [r.book_key for r in readers.texts(spark, str(tmp_path / "texts")).collect()] == ["good"]


def test_sinks_can_be_read_again(spark, tmp_path):
    texts = [("a b", "one\ntwo"), ("c#", ""), ("d", "x\n"), ("e", "\n\n")]
    writers.text_files(spark.createDataFrame(texts, "book_key string, text string"), str(tmp_path / "t"), force=True)
    assert sorted(map(tuple, readers.texts(spark, str(tmp_path / "t")).collect())) == texts
    writers.binary_files(spark.createDataFrame([("x", bytes(range(256)))], "book_key string, content binary"), str(tmp_path / "b"))
    assert readers.sizes(spark, str(tmp_path / "b")).first().n_bytes == 257
    assert spark.read.format("binaryFile").load(str(tmp_path / "b")).first().content == bytes(range(256)) + b"\n"


def test_epub(spark, tmp_path):
    path = tmp_path / "book.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("c.opf", '<package xmlns="x"><manifest><item id="a" href="02_b.xhtml"/><item id="b" href="01_Cover.xhtml"/><item id="i" href="51_Index.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="i"/></spine></package>')
        z.writestr("01_Cover.xhtml", "<p>cover</p>")
        z.writestr("02_b.xhtml", '<body><h1>Book</h1><h2 class="Chap-no">1</h2><h2>Title &amp; more</h2><p class="chap-author">Someone</p><p>Text <b>bold</b>.</p><h3>Sub</h3></body>')
        z.writestr("51_Index.xhtml", '<p class="level1">Cortex, 33 , 195–196</p><p class="level2">visual, 4</p><p class="level3">deep, 5</p><p class="level3">none</p><p class="level1">Brain. See Cortex</p><p class="level1">Brain</p><p class="level3">x, 9</p>')
    docs = readers.epub_documents(spark, str(path))
    assert [r.name for r in docs.orderBy("doc_seq").collect()] == ["01_Cover.xhtml", "02_b.xhtml", "51_Index.xhtml"]
    elements = readers.html_elements(docs, ("book_key", "doc_seq", "name"))
    assert readers.epub_markdown(elements).first().markdown == "<!-- ch. 1 -->\n\n# Title & more\n\nText bold .\n\n## Sub\n\n"
    found = {r.term: r.pages for r in readers.epub_index(elements).collect()}
    assert found == {"Cortex": ["33", "195–196"], "Cortex > visual": ["4"], "Cortex > visual > deep": ["5"], "Brain": [], "Brain > x": ["9"]}


def test_stream_of_indices(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Cortex, 10\nBrain, 3\n")
    indices.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.term for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Cortex", "Brain"}


def test_registered_claims_hold_whole_texts(spark):
    from lexgrove.plans import text_queries as Q

    sf = "/root/testdata/sf0.001"
    talks = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = {(str(r.conv_id), r.turn): "x" + (r.text or "").replace('"', "").replace("\n", " ") for r in talks}
    got = {(r.file, r.claim_ord): r.text for r in Q.amap_claims(spark, sf).collect()}
    assert got == want and max(map(len, got.values())) > 60


def test_any_number_of_settings(spark):
    """Every book keeps its own setting, however many there are."""
    from lexgrove.operators import pages
    from lexgrove.plans import build

    n = 1200
    registry = spark.range(n).selectExpr("concat('b', id) AS book_key", "concat('^## Sources ', id, '$') AS ref_heading_pattern")
    body = F.expr("concat('<!-- p. 3 -->\n## A long title\ntext\n## Sources ', id, '\nSmith, J. (2001). A title. Journal.\n')")
    lines = spark.range(n + 1).select(F.concat(F.lit("b"), F.col("id")).alias("book_key"), F.when(F.col("id") == n, "<!-- p. 3 -->\n## A long title\n## References\nSmith, J. (2001). A title. Journal.\n").otherwise(body).alias("markdown"))
    found = build.extract_references(lines, registry)
    assert found["chapters"].select("book_key").distinct().count() == n + 1 and found["references"].count() == n + 1
    tuned = spark.range(n).selectExpr("concat('b', id) AS book_key", "1.0 - id / 4000 AS global_thresh", "30 AS window_size", "1.0D AS window_thresh")
    page = "concat('head', CASE WHEN p < 9 THEN '' ELSE CAST(p AS STRING) END, '\n', 'x', p, '\ny', p, '\nz', p, '\nu', p, '\nv', p, '\nw', p)"
    segments = spark.range(n).crossJoin(spark.range(10).withColumnRenamed("id", "p")).selectExpr("concat('b', id) AS book_key", "CAST(p AS INT) AS pdf_page", "CAST(p AS INT) AS book_page", f"{page} AS text")
    got = {r.book_key for r in pages.bad_lines_by_book(segments, tuned).where("line = 'head'").collect()}
    assert got == {f"b{i}" for i in range(n) if 0.9 >= 1.0 - i / 4000 - 1e-12}


def test_numbers_of_a_table_that_is_sampled(spark):
    """Bounds of range partitions are drawn from a sample once, so every number comes once."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(400_000, numPartitions=16).select("id", F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 20).alias("more"))
        out = ranking.numbered(rows, [(F.col("k"), False)])
        got = out.agg(F.countDistinct("ord").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high"), F.sum(F.length("more"))).first()
        assert (got.n, got.low, got.high) == (400_000, 1, 400_000)
        from pyspark.sql import Window

        assert out.withColumn("before", F.lag("k").over(Window.orderBy("ord"))).where("before >= k").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_epub_rows_come_in_pieces():
    import time

    frames = list(readers._pieces(((n,) for n in range(2 * readers.TOGETHER + 1)), ["n"]))
    assert [len(f) for f in frames] == [readers.TOGETHER, readers.TOGETHER, 1]
    # the reading order of many documents is found without going through all of them for each
    names = [f"{n}.xhtml" for n in range(20000)]
    items, spine = "".join(f'<item id="i{n}" href="{x}"/>' for n, x in enumerate(names)), "".join(f'<itemref idref="i{n}"/>' for n in reversed(range(1, 20000)))

    class Archive:
        namelist = lambda self: [*names, "b.opf"]
        read = lambda self, _: f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>"

    began = time.process_time()
    assert readers._reading_order(Archive()) == [*reversed(names[1:]), names[0]]
    assert time.process_time() - began < 3
