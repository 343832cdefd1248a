"""Top-k search, token alignment and the filter audit: against brute force."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import filter_audit as A
from lexgrove.llm import token_alignment as L
from lexgrove.llm import topk_search as S

VECTORS = "vec_id long, embedding array<float>, id string, v int, row int"


# --- top-k search ---------------------------------------------------------------------------
def best(rows, k=5, every=50, scale=256):
    """Each query's best rows by trying all; equal ids count once, with their smallest vector."""
    held = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(scale * float(np.float32(c))) for c in x]
        held[i] = min(held.get(i, v), v)
    out = []
    for q, x in held.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in held.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in S.search(df, F.expr("id % 50 = 0"), **options).select("query_id", "rank", "vec_id", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "other", 7, 8) for i, x in rows], VECTORS)


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_search_against_all_scores(spark, lists, monkeypatch):
    monkeypatch.setattr(S, "CELL", 60)
    monkeypatch.setattr(S, "SHARD", 3)
    monkeypatch.setattr(S, "STEP", 17)
    monkeypatch.setattr(S, "SEEN", 8)
    rnd = np.random.default_rng(lists)
    rows = [(int(i), rnd.normal(size=7).tolist()) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(1000, 1090)]  # copies of a query, queries among them
    rows += [(i, [0.5] * 7) for i in range(2000, 2050)] + [(-50, [1.0] * 7), (3000, [0.0] * 7)]
    assert found(frame(spark, rows), lists=lists) == best(rows)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (None, [9.0, 9.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0]), (7, [0.0, 0.0, 5.0]), (50, [-1.0, -0.001]), (50, [-1.0, -0.001]), (8, [2.0, 2.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0])]
    held = [(i, (x + [0.0] * 3)[:3] if x is not None else None) for i, x in rows]
    assert found(frame(spark, rows)) == best(held)
    assert found(frame(spark, [])) == [] and found(frame(spark, [(1, [1.0]), (2, [2.0])])) == []
    assert found(frame(spark, [(0, [1.0])])) == [] and found(frame(spark, [(0, [1.0]), (50, [2.0])])) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    large = [(0, [3e4, 1.0]), (1, [3e4, -1.0]), (2, [1e6, 0.5])]
    assert found(frame(spark, large)) == best(large)
    with pytest.raises(ValueError, match="do not fit"):
        found(frame(spark, [(0, [1e30])]))


# --- token alignment ------------------------------------------------------------------------
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return L.Pair(*PATHS)


def aligned(pair, text):
    """(n_a, n_b, n_groups, n_links, digest), links by a plain walk over whole encodings."""
    none = (0, 0, 0, 0, ""), []
    if not text:
        return none
    whole = " " + text
    a, b = pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(text)
    spelt_a, spelt_b = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if b"".join(spelt_a) != whole.encode() or b"".join(spelt_b) != whole.encode():
        return none
    ends_a, ends_b = (np.cumsum([len(x) for x in spelt]).tolist() for spelt in (spelt_a, spelt_b))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = [], []
        while i < len(a) and ends_a[i] <= end:
            x.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= end:
            y.append(b[j])
            j += 1
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        links += [(u, v) for u in x for v in y]
    return (len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


PARTS = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", " ", " ", "　", "日", "한", "😀", "▁", "<s>", "<|endoftext|>", "<0x41>", "'s", "'ll", "12", "\r\n", "…", "\u0085", "\x1c", "\x00", "i̇", "ɐ", " the", " and", "word", "Łódź", "×"]


def test_words_align_as_whole_texts_do(pair, monkeypatch):
    monkeypatch.setattr(L.K, "PIECE", 150)
    monkeypatch.setattr(L, "REMEMBERED", 400)
    monkeypatch.setattr(L, "LEARNT", 37)
    rnd = random.Random(3)
    texts = [None, "", " ", "  ", "\n"] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    words = L.Words(pair)
    for k in range(0, len(texts), 250):
        part = texts[k : k + 250]
        for text, r in zip(part, L.align_slice(pa.array(part, pa.string()), words).to_pylist()):
            want, links = aligned(pair, text)
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == want, text
            counted = {}
            for u, v in links:
                counted[u * words.base + v] = counted.get(u * words.base + v, 0) + 1
            assert dict(zip(r["pairs"], r["times"])) == counted
        words.settle()
        assert len(words.known) <= 400 + 250 * 40


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_counts_of_links(spark, pair, monkeypatch, few):
    monkeypatch.setattr(L, "BROADCAST_PAIRS", few)
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdeinrst") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3]), (100, None), (101, ""), (102, "▁"), (103, "x" * 70_000), (104, " ".join(texts))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pairs int, row int")
    got = sorted((tuple(r) for r in L.align(df, *PATHS).collect()), key=repr)
    seen = [aligned(pair, t) for _, t in rows]
    count, most = {}, {}
    for _, links in seen:
        for link in set(links):
            count[link] = count.get(link, 0) + 1
    for (u, _), n in count.items():
        most[u] = max(most.get(u, 0), n)
    want = [(i, *s[:4], sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), s[4]) for (i, _), (s, links) in zip(rows, seen)]
    assert got == sorted(want, key=repr)
    if few:
        assert L.align(df.limit(0), *PATHS).count() == 0
        assert L.align(df.where("doc_id > 99"), *PATHS, keep=("pairs", "row")).columns[:2] == ["pairs", "row"]


# --- filter audit ---------------------------------------------------------------------------
def failed(docs):
    """(part, mask) of each document, by the conditions as they stand."""
    out = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        marks = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), same]
        out.append((i, source or "", sum(1 << k for k, m in enumerate(marks) if m)))
    return out


def audited(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows, out = failed(docs), {}
    for part in {p for _, p, _ in rows}:
        own = [(i, m) for i, p, m in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(i, m) for i, m in left if m & bit]
                before = [m for i, m in own if m & bit and (i, m) not in left]
                redundant = sum(1 for _, m in own if m & bit) - len(gone)
                left = [(i, m) for i, m in left if not m & bit]
                shapley[letter] += len(gone)
                assert len(before) <= redundant
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(m == bit for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shapley[row[-1]] if isinstance(row[-1], str) else row[-1]
    return out


DOCS = "doc_id long, text string, source string, mask int, part string, n int"


def corpus(rnd):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    docs = [(n, " ".join(word() for _ in range(rnd.choice((5, 150, 199, 200, 260)))), f"s{n % 3}") for n in range(60)]
    docs += [(100 + n, rnd.choice(docs)[1], rnd.choice(("s1", None, ""))) for n in range(40)]
    docs += [(200, "A bc " * 60, "s0"), (201, "x y " * 120 + "\t", "s0"), (202, " ".join(map(str, range(250))) + " $", "s0"), (203, "X" + "a" * 49, "s0"), (204, "X" + "a" * 48, "s0"), (205, None, "s1"), (206, "", "s1"), (None, "", None), (None, docs[0][1], "s2"), (3, docs[3][1], "s0"), (3, docs[3][1] + "x", "s0"), (207, "\n\x0b  é", "s2"), (208, "z" * 70_000, "s2"), (209, "z" * 69_999 + "y", "s2"), (210, "z" * 70_000, "s2")]
    rnd.shuffle(docs)
    return docs


def test_audit_against_all_orders(spark):
    rnd = random.Random(6)
    docs = corpus(rnd)
    labels = [(n, rnd.choice((0, 1, None)), rnd.choice((0, 1))) for n in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, s, 1, "p", 2) for i, t, s in docs], DOCS)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in A.audit(A.failures(df), told).collect()}
    assert got == audited(docs, labels)
    assert A.audit(A.failures(df.limit(0)), told).count() == 0
    assert A.audit(A.failures(df), told.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_copies_whose_hashes_agree(spark, monkeypatch):
    """Different texts with equal hashes throughout are told apart by their text."""
    monkeypatch.setattr(A, "block_hashes", lambda text, n: F.array(F.lit(1).cast("long")))
    docs = [(n, f"text number {n % 4}", "s") for n in range(12)] + [(20, "alone at all", "s"), (None, "text number 1", "s")]
    df = spark.createDataFrame([(i, t, s, 1, "p", 2) for i, t, s in docs], DOCS)
    assert sorted((tuple(r) for r in A.failures(df).collect()), key=repr) == sorted(failed(docs), key=repr)


def test_refinement_keeps_only_classes_of_several(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2)
    texts = ["", "", "a", "b", "ab", "ab", "abcd", "abce", "abcdefgh", "abcdefgh", "abcdefgi", "xbcdefgh"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("n", F.char_length("text"))
    marks = df.withColumn("hashes", A.block_hashes(F.col("text"), F.col("n"))).withColumn("class", A.refined(F.col("n"), F.col("hashes")))
    several = {r["class"] for r in A.surviving_classes(marks).collect()}
    assert sorted(r.text for r in marks.collect() if r["class"] in several) == ["", "", "ab", "ab", "abcdefgh", "abcdefgh"]
    assert [len(r.hashes) for r in marks.orderBy("n", "text").collect()] == [0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 3]
