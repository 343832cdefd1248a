"""Jaccard join, components, decontamination, URL rules: against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import decontamination as D
from lexgrove.llm import jaccard_join as J
from lexgrove.llm import url_rules
from lexgrove.llm.graph import components
from lexgrove.llm.queries import OP4_SQL, RULES
from lexgrove.llm.signature_tree import Groups, Tree, join, width_for

DOCS = "doc_id long, text string, node string, component_id long, key long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(4)])) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and 100 * len(s & t) >= 85 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    """Texts with exact, near and borderline copies, shared passages, tiny texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        kind = rnd.random()
        if out and kind < 0.5:
            w = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
        elif kind < 0.6:
            out.append(" ".join([word() for _ in range(rnd.randint(0, 8))]))
        elif kind < 0.75:
            out.append(" ".join(passage + [word() for _ in range(rnd.randint(0, 12))]))
        else:
            out.append(" ".join(word() for _ in range(rnd.randint(5, 120))))
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 512), (2, 8), (3, 3)])
def test_jaccard_components(spark, seed, chunk):
    texts = [(i, t) for i, t in enumerate(corpus(seed))]
    df = spark.createDataFrame([(i, t, "x", -1, 7) for i, t in texts], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, chunk_sets=chunk).collect()}
    assert got == brute(texts)


def test_words_without_structure(spark):
    """A Thue-Morse word and its complement share every polynomial hash modulo 2**64 from 1024 letters on."""
    flip = str.maketrans("ab", "ba")
    rows, word = [], "a"
    while len(word) < 4096:
        word += word.translate(flip)
        if len(word) >= 512:
            rows += [(len(rows), f"x y z {word}"), (len(rows) + 1, f"x y z {word.translate(flip)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()}
    assert got == {i: i for i, _ in rows}


def test_jaccard_with_tags(spark):
    rows = [(7, "a b c d e", 1), (7, "a b c d e f g h i j k l", 2), (3, "A b c d E", 9), (8, "a b c d e f g h i j k l", 0), (8, "a b c d e f g h i j k l", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t long")
    got = sorted((r.doc_id, r.tag, r.component_id, r.component_tag) for r in J.jaccard_components(df, tag=F.col("t")).collect())
    assert got == [(3, 9, 3, 9), (7, 1, 3, 9), (7, 2, 7, 2), (8, 0, 7, 2), (8, 0, 7, 2)]


@pytest.mark.parametrize("spread", [3, 40])
def test_large_blocks(spark, spread):
    """Blocks of many chunks, in which copies of copies drift apart, against brute force."""
    rnd = random.Random(spread)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
    texts = []
    for i in range(120):
        w = list(rnd.choice(texts[-spread:]).split() if texts else base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, chunk_sets=4).collect()}
    assert got == brute(list(enumerate(texts)))


def test_component_join_is_dealt_by_plain_shuffles(spark):
    """One hub's children are in a join that adaptive execution can split: either side is a shuffle of its own."""
    edges = spark.range(5000).select(F.col("id").alias("a"), F.lit(-1).alias("b")).union(spark.createDataFrame([(-1, -5), (-5, -7)], "a long, b long"))
    assert {r.component for r in components(edges).collect()} == {-7}


def test_jaccard_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (None, "one two"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e"), (9, "one two three")]
    df = spark.createDataFrame([(i, t, "x", -1, 7) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 1, 9)], key=str)
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_segment_keys_miss_no_link():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = rng.random(len(a)) < rng.choice([0.0, 0.03, 0.08, 0.12])
        b = np.unique(np.append(a[~drop], rng.integers(0, 2**64, int(rng.integers(0, max(1, n // 9) + 1)), dtype=np.uint64)))
        if not len(a) or not len(b):
            continue
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            one, two = ({m: (spare, keys) for m, spare, keys in J.segment_keys(x, 85)} for x in (a, b))

            def kept(own, other):
                """The keys that stay where the two sets are alone, and where every key is shared with some third set."""
                spare, keys = own
                both = keys[np.isin(keys, other[1])]
                return set(both[: len(both) - spare].tolist()), set(keys[: len(keys) - spare].tolist())

            pairs = [(kept(one[m], two[m]), kept(two[m], one[m])) for m in one.keys() & two.keys()]
            assert any(x[0] & y[0] for x, y in pairs) and any(x[1] & y[1] for x, y in pairs)


def test_common_passages_make_no_blocks(spark):
    """Texts that share a fifth of their words, and copies among them: only the copies meet."""
    rnd = random.Random(9)
    passage = [f"p{n}" for n in range(24)]
    texts = []
    for i in range(300):
        if i % 30 == 29:
            w = texts[-1].split()
            w[3] = f"x{i}"
        else:
            w = passage + [f"w{rnd.randrange(10**6)}" for _ in range(96)]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert got == brute(list(enumerate(texts)))
    sets = list(J.K.shingle_sets(*J.K.buffer_of(J.pa.array(texts)), 4))
    held = {}
    for i, s in enumerate(sets):
        for _, _, keys in J.segment_keys(s, 85):
            for key in keys.tolist():
                held.setdefault(key, set()).add(i)
    kept = 0
    for s in sets:
        for _, spare, keys in J.segment_keys(s, 85):
            shared = [k for k in keys.tolist() if len(held[k]) > 1]
            kept += len(shared) > spare
    assert sum(any(len(held[k]) > 1 for _, _, x in J.segment_keys(s, 85) for k in x.tolist()) for s in sets) > 2 * kept


def test_tree_join_against_pairs():
    rng = np.random.default_rng(3)
    for trial in range(20):
        base = [np.unique(rng.integers(0, 2**64, int(rng.integers(1, 200)), dtype=np.uint64)) for _ in range(6)]
        sets = []
        for _ in range(60):
            s = base[int(rng.integers(6))]
            s = s[rng.random(len(s)) > rng.choice([0, 0.05, 0.2])]
            sets.append(s if len(s) else base[0])
        half = 25
        w = width_for(sets)
        left, right = Tree(sets[:half], w), Tree(sets[half:], w)
        groups = Groups(60)
        join(left, left, 85, groups, (0, 0)), join(right, right, 85, groups, (half, half)), join(left, right, 85, groups, (0, half))
        want = Groups(60)
        for i in range(60):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                    want.union(i, j)
        assert [groups.find(i) for i in range(60)] == [want.find(i) for i in range(60)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(1, None), (5, 5)]
    groups = Groups(500)
    for a, b in edges:
        if b is not None:
            groups.union(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: groups.find(i) for a, b in edges if b is not None and a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_tiles(item, text, least):
    """Greedy tiling by trying every pair of places."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            a[i + k] = b[j + k] = False
        out.append((i, j, n))


def test_tiles_against_all_places():
    rnd = random.Random(8)
    for _ in range(200):
        item, text = ([rnd.randint(1, 5) for _ in range(rnd.randint(1, 14))] for _ in "ab")
        assert D.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 2) == slow_tiles(item, text, 2)


ITEM = "the quick brown fox jumps over the lazy dog and then sleeps under an old tree"
BENCH = "item_id long, text string, doc_id long"


def test_leaks(spark):
    w = ITEM.split()
    shuffled = " ".join(w[8:] + ["xx"] + w[:8])
    docs = [(1, f"before {ITEM} after"), (2, f"Before THE Quick, brown fox; {' '.join(w[4:])}!"), (3, shuffled), (4, "the quick brown fox and nothing else of it"), (5, None), (6, ""), (7, "short item here"), (None, ITEM), (1, f"before {ITEM} after"), (9, " ".join(w[:7] + ["zz"] + w[8:]))]
    df = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(10, ITEM, 0), (11, ITEM.upper(), 0), (12, None, 0), (13, "", 0), (14, "short item", 0)], BENCH)
    rows = D.leaks(df, bench).collect()
    got = sorted([(r.doc_id, r.item_id) for r in rows], key=str)
    both = [(i, n) for i in (1, 1, 2, 3, 9, None) for n in (10, 11)] + [(7, 14)]
    assert got == sorted(both, key=str)
    assert {r.n_tiles for r in rows if r.doc_id == 3} == {2} and {r.coverage for r in rows if r.doc_id == 3} == {1.0}
    blocks = D.leaks(df, bench, block_bytes=1).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, rows))
    assert sorted(r.doc_id for r in D.without_leaks(df, bench).collect()) == [4, 5, 6]
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0
    assert D.without_leaks(df, bench).columns == df.columns
    assert "Exchange" not in D.without_leaks(df, bench)._jdf.queryExecution().executedPlan().toString()
    odd = df.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(1).alias("leaked_id"), F.lit(2).alias("a.b"), F.lit(3).alias("a`b"))
    assert sorted(r.doc_id for r in D.without_leaks(odd, bench, block_bytes=1).collect()) == [4, 5, 6]
    # rows of one id are judged each for itself
    twice = spark.createDataFrame([(1, ITEM), (1, "nothing of it")], "doc_id long, text string")
    assert [r.text for r in D.without_leaks(twice, bench).collect()] == ["nothing of it"]


def test_items_in_short_pieces(spark):
    """Items shuffled in pieces of three and four words or with every fifth word replaced, against tiling every pair."""
    rnd = random.Random(5)
    items = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 60))] for _ in range(12)] + [["a", "b"] * 20, ["one", "two"]]
    docs = []
    for w in items:
        for n in (3, 4):
            pieces = [w[i : i + n] for i in range(0, len(w), n)]
            rnd.shuffle(pieces)
            docs.append([x for p in pieces for x in [*p, f"x{rnd.randint(0, 9)}"]])
        docs.append([x if i % 5 else "zz" for i, x in enumerate(w)])
        docs.append(w[: len(w) // 2 - 2] + ["yy"] + w[-2:])
    want = set()
    for d, t in enumerate(docs):
        for i, w in enumerate(items):
            found = slow_tiles(w, t, min(3, len(w)))
            if found and sum(n for _, _, n in found) >= 0.5 * len(w):
                want.add((d, i, len(found)))
    df = spark.createDataFrame([(d, " ".join(t), "x", 0, 0) for d, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)], BENCH)
    assert {(4 * i + k, i) for i in range(12) for k in range(3)} <= {p[:2] for p in want}
    assert {(r.doc_id, r.item_id, r.n_tiles) for r in D.leaks(df, bench).collect()} == want


def test_words_of_other_scripts(spark):
    """Items within running text without spaces, and between typographic marks."""
    items = [(1, "今天的天气非常好我们去公园散步"), (2, "the “quick” brown fox—jumps over…the dog"), (3, "Ελληνικά γράμματα και λέξεις εδώ"), (4, "καφέ × ½ ÷ five six seven eight")]
    docs = [(1, "他说：今天的天气非常好,我们去公园散步吧。"), (2, "«The quick brown fox» jumps over the dog’s"), (3, "x;ΕΛΛΗΝΙΚΆ γράμματα, και\u00a0λέξεις εδώ·y"), (4, "plain text of nothing"), (5, "天天天天"), (6, None)]
    df = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in docs], DOCS)
    rows = D.leaks(df, spark.createDataFrame([(i, t, 0) for i, t in items], BENCH)).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in rows) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    import unicodedata

    import pyarrow as pa

    rnd = random.Random(2)
    letters = "aZ9é×÷Ωж中あก—“ \u00a0½'.ß"
    for text in ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(300)]:
        want = [w for w in "".join(c if unicodedata.category(c)[0] in "LMN" and c not in "中あก" else f" {c} " if c in "中あก" else " " for c in text.lower()).split()]
        words = D.K.tokenize(*D.K.buffer_of(D.spaced(pa.array([text]))), D.WORD_TABLE)
        raw = D.spaced(pa.array([text]))[0].as_py().encode()
        got = [raw[a:b].decode() for a, b in zip(words.starts.tolist(), words.ends.tolist())]
        assert got == want, (text, got, want)


def test_long_items(spark):
    """Items of several hundred words, copied whole and reordered."""
    rnd = random.Random(3)
    words = [f"w{n}" for n in rnd.sample(range(10**6), 300)]
    a = np.arange(1, 301, dtype=np.uint64)
    assert D.tiles(a, a, 3) == [(0, 0, 300)]
    assert D.tiles(a, np.append(a[170:], a[:170]), 3) == [(0, 130, 170), (170, 0, 130)]
    for n, least in ((150, 3), (257, 80)):
        item, text = ([rnd.randint(1, 3) for _ in range(n)] for _ in "ab")
        text[:90] = item[20:110]
        assert D.tiles(np.array(item, np.uint64), np.array(text, np.uint64), least) == slow_tiles(item, text, least)
    whole, moved = " ".join(words), " ".join(words[170:] + words[:170])
    df = spark.createDataFrame([(1, f"x {whole} y", "x", 0, 0), (2, moved, "x", 0, 0), (3, " ".join(words[:149]), "x", 0, 0)], DOCS)
    rows = D.leaks(df, spark.createDataFrame([(7, whole, 0)], BENCH)).collect()
    assert sorted((r.doc_id, r.coverage, r.n_tiles, r.longest) for r in rows) == [(1, 1.0, 1, 300), (2, 1.0, 2, 170)]
    assert D.leaks(df, spark.createDataFrame([(7, whole, 0)], BENCH), tile=100).count() == 2


def urls():
    rnd = random.Random(4)
    hosts = ["net", "a.net", "example.net", "x.example.net", "EXAMPLE.com", "b.example.com", "org", "w.org", "badexample.net", "netx", "n.et", "", "a..net", "example.net:80", "net."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/y", "/fr/", "/FR/", "/en/?q", "?en/", "#/en/", "/de/#"]
    fixed = [None, "", "no scheme", "://", "http://", "http:///en/", "ftp://u@example.net/en/", "http://a://b/c", "http://exämple.org/fr/ä"]
    return fixed + [f"http{rnd.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths]


def test_url_rules_against_sql(spark):
    import duckdb
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(len(urls())), "url": urls()})
    con = duckdb.connect()
    con.register("pages", pages)
    want = {r[0]: tuple(r[1:]) for r in con.execute(OP4_SQL).fetchall()}
    df = spark.createDataFrame([(i, u, "rule", "x") for i, u in enumerate(urls())], "page_id long, url string, rule string, host string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(df, rules).collect()}
    assert got == want


def test_url_rules_nested(spark):
    rnd = random.Random(6)
    hosts, paths = ["a", "b.a", "c.b.a", "b", "ab"], ["", "/", "/x", "/x/", "/x/y", "/xy"]
    rules = [(h, p, rnd.choice(["allow", "block"])) for h in hosts for p in paths if rnd.random() < 0.6]
    df = spark.createDataFrame([(i % 50, f"x://{rnd.choice(['', 'c.', 'b.', 'q.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'z', '/'])}") for i in range(400)], "page_id long, url string")
    rows = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), "block").collect()
    assert len(rows) == 400
    for r in rows:
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "block")), r


def test_url_rules_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_rules.judge(pages, rules.limit(0)).collect()] == [(1, "a.net", "/", None, "allow")]
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("parts, many", [(2, 4), (16, 4), (2, 2000), (16, 2000)])
def test_url_rules_beyond_the_sampler(spark, parts, many):
    """More rows than range bounds are drawn from: a rule must lie in the same part for those who open it and who carry it."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        if many == 4:
            rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
            pages = spark.range(120_000, numPartitions=8).selectExpr("id AS page_id", "concat('http://h', xxhash64(id), if(id % 2 = 0, '.net/', '.com/'), id % 7) AS url")
            want = {("net/", "block"): 60_000, (None, "allow"): 60_000}
        else:
            rules = spark.range(many).selectExpr("concat('h', id, '.net') AS host", "'/' AS path", "'block' AS verdict")
            pages = spark.range(120_000, numPartitions=8).selectExpr("id AS page_id", f"concat('http://w', id, '.h', pmod(xxhash64(id), {many}), '.net/x') AS url")
            want = None
        for _ in range(2):
            got = url_rules.judge(pages, rules)
            if want:
                assert {(r.rule, r.verdict): r.n for r in got.groupBy("rule", "verdict").agg(F.count("*").alias("n")).collect()} == want
            else:
                assert got.where("verdict = 'block' AND endswith(host, concat('.', replace(rule, '/', '')))").count() == 120_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rules_without_a_host(spark):
    rules = spark.createDataFrame([("", "/", "block"), (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x:///q"), (2, "x://a/q"), (3, None)], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()) == [(1, None, "allow"), (2, "a", "block"), (3, None, "allow")]


def test_both_verdicts_block(spark):
    rules = spark.createDataFrame([("a", "/", "allow"), ("A", "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge(spark.createDataFrame([(1, "h://a/")], "page_id long, url string"), rules).first().verdict == "block"


def test_whole_table_against_a_prefix_filter(spark):
    """All of a table's documents, against a plain filter on each set's rarest shingles with every candidate tested."""
    import pyarrow as pa

    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    table, least = df.toArrow(), 80
    sets = dict(zip(table["doc_id"].to_pylist(), J.K.shingle_sets(*J.K.buffer_of(table["text"].cast(pa.large_string()).combine_chunks()), 5)))
    every, held = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    groups, by_shingle = Groups(max(sets) + 1), {}
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        s, n = sets[i], len(sets[i])
        rare = s[np.lexsort((s, held[np.searchsorted(every, s)]))][: n - -(-least * n // 100) + 1].tolist()
        for j in {j for x in rare for j in by_shingle.get(x, ())}:
            common = len(np.intersect1d(s, sets[j], assume_unique=True)) if groups.find(i) != groups.find(j) else 0
            if common and 100 * common >= least * (n + len(sets[j]) - common):
                groups.union(i, j)
        for x in rare:
            by_shingle.setdefault(x, []).append(i)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, 5, least).collect()}
    assert got == {i: (len(s), groups.find(i)) for i, s in sets.items()}
