"""The pipeline's stages against plain versions of their decisions, and the registered queries."""

import math
import re
import struct
import zlib
from collections import Counter

import __spark_entry__ as e
import corpus_pipeline as P
import pyarrow as pa
from pyspark.sql import functions as F

from lexgrove.llm import toxicity
from lexgrove.llm.queries import fold, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.lit("x").alias("score"))
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars", "score")
    again = docs.orderBy("doc_id").limit(2)
    none = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars", "score")
    docs = docs.union(extra).union(again).union(none)
    held = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
            assert docs.exceptAll(before).count() == 0
        held[name] = docs.count()
    counts = list(held.values())
    assert 201 <= counts[0] <= 203 and counts[0] >= counts[1] >= counts[2] >= counts[3] > 100
    assert spark.read.parquet(str(tmp_path / "0")).where("doc_id = 1000000").count() == 0
    kept, given = ([(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / str(k))).collect()] for k in (2, 1))
    assert sorted(map(str, kept)) == sorted(map(str, one_of_each(given)))
    # language: only texts without any letter are of no language; toxicity: every row by its own score
    first, second = ([(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / str(k))).collect()] for k in (0, 1))
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert set(first) >= {x for x in given if any(c.isalpha() for c in x[1] or "")} and not any(not any(c.isalpha() for c in t or "") for _, t in first)
    model = toxicity.fit(spark.read.parquet(str(tmp_path / "0")), spark.read.parquet(f"{SF}/labels.parquet").where(~fold(3, 1)))
    assert sorted(map(str, second)) == sorted(str(x) for x in first if plain_score(model, x[1]) < toxicity.THRESHOLD)
    packed_as(spark.read.parquet(str(tmp_path / "3")).select("doc_id", "text").collect(), spark.read.parquet(str(tmp_path / "4")).collect())
    # the next stage against tiling every document with every item
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "3")).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, [(i, t) for i, t in kept if not any(leaks_into(x, t) for x in items)]))


def plain_score(model, text):
    """The logistic score of one text, from a sum over the model's features that it has."""
    here = set(toxicity.Counts(pa.array([text])).feature.tolist())
    logit = model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights.tolist()) if f in here)
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


def packed_as(docs, pieces):
    """Every document's ids are cut into its pieces, and sequences are filled without gaps."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    want, got, held = Counter(), Counter(), {}
    for r in docs:
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    for r in pieces:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in held.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    least = -(-sum(n for places in held.values() for _, n in places) // 2048)
    assert least <= len(held) <= least + 2


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def one_of_each(rows):
    """The rows that stay of (doc_id, text), by comparing all pairs: ids first, rows without one last; equal rows once."""
    rows = list(dict.fromkeys(rows))
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, row in enumerate(rows):
        r = find(i)
        if r not in best or (row[0] is None, row[0] or 0) < (best[r][0] is None, best[r][0] or 0):
            best[r] = row
    return list(best.values())


def plain_words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def leaks_into(item, text):
    """Greedy tiling of an item's words by whole-string search, three words at least, half of the item."""
    item, text = plain_words(item), plain_words(text)
    least = min(3, len(item))
    if not item:
        return False
    grams = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
    held = {g for g in zip(*[text[i:] for i in range(least)])} & grams
    if len(held) * least < 0.5 * len(item):
        return False
    from tests.llm.test_joins import slow_tiles

    spots = sorted({j + d for j in range(len(text) - least + 1) if tuple(text[j : j + least]) in held for d in range(least)})
    near = [text[j] if j in set(spots) else f"gap {j}" for j in range(len(text)) if j in set(spots) or j - 1 in set(spots)]
    found = slow_tiles(item, near, least)
    return sum(n for _, _, n in found) >= 0.5 * len(item)


def test_rows_are_judged_each_for_itself(spark):
    """Null and repeated ids, clashing and odd column names, in all stages that keep documents."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    words = " ".join(f"w{n}" for n in range(60))
    near = words.replace("w30 ", "zz ")
    rows = [(None, words), (None, words), (None, near), (5, near), (5, near), (5, "quite another text of this id here"), (6, "quite another text of this id here"), (None, f"so {item} it is"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2.0, 3) for i, t in rows], "doc_id long, text string, lang string, found_score int, `found score` double, `a.b` int")
    kept = P.one_of_each_group(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(5, near), (5, "quite another text of this id here"), (None, f"so {item} it is"), (None, None), (9, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    clean = P.without_benchmark(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1
    for stage in (P.known_language, P.not_toxic):
        assert stage(spark, docs, SF).columns == docs.columns


def test_near_duplicates_by_five_words(spark):
    """Against brute force with five words and 0.8: spread edits, one changed passage, and a text beyond the threshold."""
    words = [f"w{n}" for n in range(1000)]
    spread = lambda n: " ".join("zz%d" % i if i % (1000 // n) == 20 and i // (1000 // n) < n else w for i, w in enumerate(words))
    passage = " ".join(words[:450] + [f"y{n}" for n in range(100)] + words[550:])
    texts = [(1, " ".join(words)), (2, spread(22)), (3, passage), (4, spread(25)), (5, "other words here")]
    sets = {i: {tuple(t.split()[n : n + 5]) for n in range(max(1, len(t.split()) - 4))} for i, t in texts}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {x: new if r == old else r for x, r in root.items()}
    kept = P.one_of_each_group(spark, spark.createDataFrame(texts, "doc_id long, text string"), SF)
    assert {r.doc_id for r in kept.collect()} == set(root.values()) == {1, 4, 5}


def test_run_and_registration(spark):
    assert P.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    names = set(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, q in e.queries().items():
        if name.startswith("op") or name == "pipeline":
            assert q(spark, str(tmp_path)).count() == 0, name
