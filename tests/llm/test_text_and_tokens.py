"""Text kernel, exact token ids, length histograms, packing."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import packing, token_counts
from lexgrove.llm import textkernel as K
from lexgrove.llm.queries import tokenizer_path
from lexgrove.llm.word_bpe import Encoder

DOCS = "doc_id long, text string, length long, node string"


def odd_texts(n=400, seed=3):
    rnd = random.Random(seed)
    bits = ["a", "B", "é", "É", "İ", "ß", "Σ", "'", "’", "s", "'s", "<|endoftext|>", "<", "|", ">", "!", ".", "3", "٣", "½", "×", " ", "\n", "\t", "\x0b", " ", "\u3000", "\u0301", "中", "🙂", "\x00", "\x1c", "I'll", "-", "10"]
    return ["", " ", "\n\n"] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_hashes(monkeypatch):
    texts = odd_texts()
    seen = {}
    for piece in (1 << 20, 64):  # small pieces cut nothing differently
        monkeypatch.setattr(K, "PIECE", piece)
        tokens = K.tokenize(*K.buffer_of(pa.array([*texts, None])))
        assert np.diff(tokens.bounds).tolist() == [len(words(t)) for t in texts] + [0]
        for word, h in zip((w for t in texts for w in words(t)), tokens.hashes.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    texts = ["a b c d e", "A b C d", "a b c", "", None, "a b c d a b c d", "\tx  y\nz\r\n"]
    sets = [s.tolist() for s in K.shingle_sets(*K.buffer_of(pa.array(texts)), 4)]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 4, 1]
    assert set(sets[1]) < set(sets[0]) and not set(sets[2]) & set(sets[0])


def test_sliced_column():
    whole = pa.array(["one two", None, "three", ""])
    assert [len(s) for s in K.shingle_sets(*K.buffer_of(whole.slice(1)), 1)] == [0, 1, 0]


def test_words_of_a_regular_make(spark):
    """Thue-Morse words and their complements, which polynomial hashes modulo 2**64 take for one."""
    flip = str.maketrans("ab", "ba")
    rows, word = [], "a"
    while len(word) < 2048:
        word += word.translate(flip)
        if len(word) >= 512:
            rows += [f"{word} and", f"{word.translate(flip)} and"]
    e = Encoder(tokenizer_path())
    want = [x.ids for x in e.tokenizer.encode_batch(rows, add_special_tokens=False)]
    ids, bounds = e.encode(pa.array(rows))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(df, tokenizer_path(), 4096).collect()}
    assert got == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(want)}
    counts = {r.length: r.n_docs for r in token_counts.length_histogram(df, tokenizer_path()).collect()}
    assert counts == {n: sum(len(x) == n for x in want) for n in {len(x) for x in want}}


@pytest.mark.parametrize("most", [30, 5000])
def test_context_table_of_any_lengths(spark, most):
    """Every figure of random histograms against sums over all texts."""
    rng = np.random.default_rng(most)
    lengths = np.concatenate([rng.integers(0, most, 400), rng.integers(0, 40, 300), [0, 127, 128, 1024]])
    kinds, many = np.unique(lengths, return_counts=True)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(kinds, many)], "length long, n_docs long")
    table = token_counts.context_table(df)
    rows = {r.context_limit: r for r in table.collect()}
    assert set(rows) == set(kinds.tolist())
    for n, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.docs_at_most) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), np.minimum(lengths, n).sum(), (lengths <= n).sum())
    asked = [0, 1, 17, 100, 10**6]
    got = {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(table, spark.createDataFrame([(x,) for x in asked], "context_limit long")).collect()}
    assert got == {x: np.minimum(lengths, x).sum() for x in asked}
    for share in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(table, share).first().length == min(n for n in kinds.tolist() if (lengths <= n).sum() >= share * len(lengths) - 1e-9)


def test_ids_are_the_tokenizer_s():
    texts = odd_texts(3000)
    e = Encoder(tokenizer_path())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, bounds = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert e.lengths(pa.array(texts)).tolist() == [len(x) for x in want]


def test_histogram_and_limits(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(["a b c", "a b c", "", None, "a", "a b c d e f"])]
    df = spark.createDataFrame(rows, DOCS)
    lengths = [3, 3, 0, 0, 1, 6]
    table = token_counts.context_table(token_counts.length_histogram(df, tokenizer_path())).persist()
    for r in table.collect():
        n = r.context_limit
        assert (r.n_docs, r.docs_at_least, r.docs_at_most) == (lengths.count(n), sum(x >= n for x in lengths), sum(x <= n for x in lengths))
        assert (r.tokens_at_least, r.truncated_tokens) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
    limits = spark.createDataFrame([(n,) for n in (0, 2, 3, 5, 6, 100)], "context_limit long")
    assert {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(table, limits).collect()} == {n: sum(min(x, n) for x in lengths) for n in (0, 2, 3, 5, 6, 100)}
    assert token_counts.quantile(table, 0.5).first().length == sorted(lengths)[2]
    assert token_counts.context_table(token_counts.length_histogram(df.limit(0), tokenizer_path())).count() == 0


def test_fullest_against_all_subsets():
    from itertools import product

    rnd = random.Random(1)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(1, 20), rnd.randint(1, 5)), reverse=True)
        counts = [rnd.randint(1, 3) for _ in lengths]
        room = rnd.randint(0, 40)
        best = max(s for p in product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(p, lengths))) <= room)
        chosen = packing.fullest(lengths, counts, room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[lengths.index(k)] for k, n in chosen.items())


def test_plan_places_everything_once():
    rnd = random.Random(2)
    for size in (16, 2048):
        histogram = {rnd.randint(1, size): rnd.randint(1, 60) for _ in range(40)}
        rows = packing.plan(histogram, size)
        assert {k: sum(b - a for n, a, b, *_ in rows.tolist() if n == k) for k in histogram} == histogram
        used, bins = sum({s: (b - a) // m for _, a, b, m, s, _ in rows.tolist()}.values()), []
        for k in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):  # first fit, longest first
            at = next((i for i, room in enumerate(bins) if room >= k), None)
            if at is None:
                bins.append(size - k)
            else:
                bins[at] -= k
        assert used <= 1.03 * len(bins)
    assert packing.plan({}, 2048).shape == (0, 6)


def check_packing(rows, texts, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, filled = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(k // size, k, ids[k : k + size]) for k in range(0, len(ids), size)]
        got = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(p, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, s, x in want]
    return len(filled)


def test_pack(spark):
    texts = dict(enumerate([*odd_texts(150), None, "word " * 5000, "a " * 15, "a " * 16, "b " * 31]))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], DOCS).repartition(3)
    for size in (16, 2048):
        assert check_packing(packing.pack(df, tokenizer_path(), size).collect(), texts, size)
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(None, "a", 1, "x"), (None, "a", 1, "x"), (1, "a", 1, "x"), (1, "a", 1, "x")], DOCS)
    rows = packing.pack(twice, tokenizer_path()).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


@pytest.mark.parametrize("n", [1, 3])
def test_pack_is_the_same_on_any_partitioning(spark, n):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 40).cast("int")).alias("text")).repartition(n)
    assert packing.pack(df, tokenizer_path(), 64).select("sequence_id").distinct().count() == packing.pack(df.repartition(5), tokenizer_path(), 64).select("sequence_id").distinct().count()
