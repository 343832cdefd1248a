"""Language, toxicity, quality: held-out accuracy, edge cases, parts against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import language_id, ordinal_quality, toxicity
from lexgrove.llm.queries import QUERIES
from lexgrove.llm.samples import balanced

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, label long"


def texts_of(spark, n=200):
    rnd = random.Random(1)
    parts = {"aa": ["lo", "mi", "ra", "tu"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["ñe", "ción", "ar", "os"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(parts))
        rows.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 40))), lang, 0.0, 1))
    return spark.createDataFrame(rows, DOCS)


def test_presence_against_sets():
    texts = ["Ab, cd!", "", "...", "x", "?y", "é1É", "x" * 50, None]
    got = language_id.presence(pa.array(texts))
    import re

    def grams(t):
        s = re.sub(rb"[^a-z\x80-\xff]+", b" ", (t or "").lower().encode()).lstrip(b" ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    sets = [grams(t) for t in texts]
    assert [int(x) for x in got.sum(axis=1)] == [len(s) for s in sets]  # no collisions among so few
    for i in range(len(texts)):
        for j in range(i):
            assert int((got[i] & got[j]).sum()) == len(sets[i] & sets[j])


def test_language(spark):
    df = texts_of(spark)
    model = language_id.fit(df.where("doc_id % 4 <> 2"))
    rows = language_id.identify(df, model, ("doc_id", "lang", "label", "text")).collect()
    assert len(rows) == 200 and all(r.lang_pred == r.lang for r in rows if r.doc_id % 4 == 2)
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].text
    odd = spark.createDataFrame([(1, None, None, 0.0, 1), (2, "", None, 0.0, 1), (3, "123 !?", None, 0.0, 1), (None, "lomi ratu", None, 0.0, 1), (4, "lomi ratu", None, 0.0, 1), (4, "lomi ratu", None, 0.0, 1), (5, "中" * 200_000, None, 0.0, 1)], DOCS)
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(odd, model).collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and [p for _, p in got[3:6]] == ["aa"] * 3 and len(got) == 7
    assert language_id.identify(df.limit(0), model).count() == 0
    untaught = language_id.fit(odd)
    assert {r.lang_pred for r in language_id.identify(df, untaught).collect()} == {"und"}


def test_language_held_out(spark):
    rows = QUERIES["op9_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_labels_of_the_held_out_fold_change_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        held = lambda n, k: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == k
        df = df.withColumn("lang", F.when(held(4, 2), "zz").otherwise(F.col("lang"))) if t == "documents" else df.withColumn("toxic", F.when(held(3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    for q in ("op9_language_id", "op3_toxicity"):
        one, two = ({r.doc_id: r.score for r in QUERIES[q](spark, d).collect()} for d in (DATA, str(tmp_path)))
        assert one == two


def toxic_texts(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        w, bad = [word() for _ in range(rnd.randint(5, 60))], rnd.random() < 0.3
        if bad:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zonk", "ZONK", "quix", "zargoo" + word()]))
        rows.append((i, " ".join(w), "x", 0.0, 1))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_texts(1200, 1)
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model, ("doc_id", "lang")).collect()}
    held = [(got[i], y) for i, y in labels if i % 3 == 1]
    assert all(s >= 0.7 for s, y in held if y) and sum(s >= 0.7 for s, y in held if not y) <= 1
    odd = spark.createDataFrame([(1, None, "x", 0.0, 1), (2, "", "x", 0.0, 1), (None, "zonk quix", "x", 0.0, 1), (3, "abc " * 200_000 + "zonk quix", "x", 0.0, 1)], DOCS)
    s = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert s[1] == s[2] < 0.1 and s[None] > 0.7 and s[3] > 0.7
    assert toxicity.score(df.limit(0), model).count() == 0
    for few in (marks.limit(0), marks.where("toxic = 0")):
        assert {r.score for r in toxicity.score(odd, toxicity.fit(df, few)).collect()} == {0.0}


def test_label_model_learns_accuracies_without_labels():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < 0.6, np.where((rng.random(4000) < acc) == y, 1, -1), 0)
    good, fair = vote(0.95), vote(0.75)
    votes = np.column_stack([good, fair, fair, fair, vote(0.8), vote(0.8)]).astype(np.int8)  # one voter three times
    posterior, evidence, parent = toxicity.label_model(votes, 0.3, np.where(votes.sum(axis=1) > 0, 0.8, 0.2))
    assert ((posterior > 0.5) == y).mean() > 0.88
    # the copies hang on one another and add nothing; independent voters hang on none
    assert parent.tolist() == [-1, -1, 1, 1, -1, -1] or parent.tolist() == [-1, -1, 1, 2, -1, -1]
    assert evidence[0, 0, 2] > 1.5 * evidence[1, 0, 2] > 0
    assert all(abs(evidence[j, a, a]) < 0.05 for j in (2, 3) for a in range(3))


def test_label_model_against_plain_loops():
    """Each round of the model against sums over texts and classes written out, for the forest that it draws."""
    rng = np.random.default_rng(7)
    y = rng.random(300) < 0.4
    first = np.where(rng.random(300) < 0.8, np.where(y, 1, -1), 0)
    votes = np.column_stack([first, np.where(rng.random(300) < 0.9, first, 0), rng.integers(-1, 2, 300), np.where(rng.random(300) < 0.7, np.where(y, 1, -1), 0)])
    start = np.where(votes.sum(axis=1) > 0, 0.9, 0.1)
    got, _, parent = toxicity.label_model(votes, 0.4, start, rounds=12)
    assert parent[1] == 0 and parent[2] == -1
    post = start.astype(float)
    for k in range(12):
        tree = toxicity._dependencies(votes, (1 - post, post)) if k in toxicity.REDRAWN else tree
        new = []
        weight = [[1 - p, p] for p in post]

        def chance(c, j, above, vote):
            own = {v: sum(w[c] for w, r in zip(weight, votes) if r[j] == v) + 0.3 for v in (-1, 0, 1)}
            share = own[vote] / sum(own.values())
            rows = [(w[c], r[j]) for w, r in zip(weight, votes) if tree[j] < 0 or r[tree[j]] == above]
            return (sum(w for w, v in rows if v == vote) + share) / (sum(w for w, _ in rows) + 1)

        known = {}
        for r in votes:
            odds = np.log(0.4 / 0.6)
            for j in range(4):
                above = r[tree[j]] if tree[j] >= 0 else None
                if (j, above, r[j]) not in known:
                    known[j, above, r[j]] = np.log(chance(1, j, above, r[j])) - np.log(chance(0, j, above, r[j]))
                odds += known[j, above, r[j]]
            new.append(1 / (1 + np.exp(-odds)))
        post = np.array(new)
    assert np.allclose(got, post, atol=1e-6)


def test_forest_is_the_best_of_all():
    """The forest's total dependency against every forest of five voters."""
    import itertools

    rng = np.random.default_rng(3)
    base = rng.integers(-1, 2, 400)
    votes = np.column_stack([np.where(rng.random(400) < p, base, rng.integers(-1, 2, 400)) for p in (0.9, 0.7, 0.5, 0.3, 0.0)])
    belief = rng.random(400)
    parent = toxicity._dependencies(votes, (1 - belief, belief))

    def shared(i, j):
        total = 0.0
        for b in (1 - belief, belief):
            for u in (-1, 0, 1):
                for v in (-1, 0, 1):
                    both = b[(votes[:, i] == u) & (votes[:, j] == v)].sum() / 400
                    alone = b[votes[:, i] == u].sum() / 400 * b[votes[:, j] == v].sum() / 400 / (b.sum() / 400)
                    total += both * np.log(both / alone) if both > 0 else 0
        return total

    said = [-sum(x * np.log(x / (b.sum() / 400)) for b in (1 - belief, belief) for v in (-1, 0, 1) if (x := b[votes[:, j] == v].sum() / 400)) for j in range(5)]
    edges = {(i, j): s for i, j in itertools.combinations(range(5), 2) if (s := shared(i, j)) > max(toxicity.CHANCE / 400, toxicity.LEAST_SHARE * min(said[i], said[j]))}

    def forest(chosen):
        group = list(range(5))
        for i, j in chosen:
            if group[i] == group[j]:
                return False
            group = [group[i] if g == group[j] else g for g in group]
        return True

    best = max(sum(edges[e] for e in c) for n in range(5) for c in itertools.combinations(edges, n) if forest(c))
    assert np.isclose(sum(edges[tuple(sorted((int(p), j)))] for j, p in enumerate(parent) if p >= 0), best, rtol=1e-4)


def test_ordinal_against_plain_likelihood(monkeypatch):
    """What learn() minimises: its value against products of probabilities, its slopes against differences."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["good", "bad", "##", "9x", "mid"]) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    grade = np.array([rnd.randrange(4) for _ in texts])
    seen = {}
    monkeypatch.setattr(ordinal_quality, "minimise", lambda f, x, **k: seen.update(f=f, n=len(x)) or x)
    ordinal_quality.learn(pa.array(texts), grade, 4)
    row, kind, value = ordinal_quality.features(pa.array(texts))
    used = sorted(set(kind.tolist()))
    x = np.random.default_rng(1).normal(0, 0.5, seen["n"])
    m = len(used)
    assert seen["n"] == m + 3
    w, cuts = dict(zip(used, x[:m])), np.cumsum([x[m], np.exp(x[m + 1]), np.exp(x[m + 2])])
    loss = 0.0
    for i, g in enumerate(grade):
        score = sum(w[k] * v for r, k, v in zip(row.tolist(), kind.tolist(), value.tolist()) if r == i)
        tail = [1.0, *(1 / (1 + np.exp(-(score - c))) for c in cuts), 0.0]
        loss -= np.log(tail[g] - tail[g + 1]) / 4 / (grade == g).sum()
    loss += ordinal_quality.RIDGE / 2 * sum(v * v for v in w.values())
    got, slopes = seen["f"](x)
    assert np.isclose(got, loss, rtol=1e-9)
    for i in [0, 1, m - 1, m, m + 1, m + 2]:
        step = np.zeros_like(x)
        step[i] = 1e-6
        assert np.isclose(slopes[i], (seen["f"](x + step)[0] - seen["f"](x - step)[0]) / 2e-6, atol=1e-6)


def test_language_against_dense_kernel_ridge(spark):
    """With every sampled text a landmark the scores are those of kernel ridge solved whole."""
    df = texts_of(spark, 60)
    texts = [(r.text, r.lang) for r in df.orderBy("doc_id").collect()]
    model = language_id.fit(df, sample_each=1000, landmarks=3 * 1000)
    bits = language_id.presence(pa.array([t for t, _ in texts])).astype(float)
    root = np.sqrt(bits.sum(axis=1))
    gram = bits @ bits.T / root[:, None] / root[None, :]
    langs = sorted({x for _, x in texts})
    target = np.array([[1.0 if x == name else -1.0 for name in langs] for _, x in texts])
    share = np.array([len(texts) / len(langs) / sum(y == x for _, y in texts) for _, x in texts])
    # weighted ridge on all landmarks: (K W K + r n K) a = K W t
    dual = np.linalg.lstsq(gram @ (gram * share[:, None]) + language_id.RIDGE * len(texts) * gram, gram @ (target * share[:, None]), rcond=1e-12)[0]
    assert np.allclose(model.scores(pa.array([t for t, _ in texts])), gram @ dual, atol=2e-3)
    other = [r.text for r in df.limit(5).select(F.concat(F.col("text"), F.lit(" lomi ung")).alias("text")).collect()]
    new = language_id.presence(pa.array(other)).astype(float)
    assert np.allclose(model.scores(pa.array(other)), (new @ bits.T / np.sqrt(new.sum(axis=1))[:, None] / root[None, :]) @ dual, atol=2e-3)


def test_sample_of_texts_is_bounded(spark, monkeypatch):
    from lexgrove.llm import samples

    df = spark.createDataFrame([(i, "x" * (i % 7 * 100)) for i in range(200)] + [(3, "x"), (4, None)], "doc_id long, text string")
    chosen = [{"doc_id": i, "label": i % 2} for i in range(0, 200, 2)]
    texts, marks = samples.labelled_texts(df, chosen, "label")
    assert len(texts) == len(marks) == 100 and set(marks) == {0}
    monkeypatch.setattr(samples, "SAMPLE_BYTES", 5000)
    few, _ = samples.labelled_texts(df, chosen, "label")
    again, _ = samples.labelled_texts(df.repartition(9), chosen, "label")
    assert 0 < len(few) < 100 and sum(len(t.as_py()) for t in few) <= 5000 and few.to_pylist() == again.to_pylist()


def test_logistic_gradient_is_zero():
    rng = np.random.default_rng(2)
    x, y, w = rng.random((200, 4)), rng.random(200), rng.random(200)
    coef, bias = toxicity.logistic(x, y, w, 1e-3)
    error = (1 / (1 + np.exp(-(x @ coef + bias))) - y) * w
    assert np.abs(x.T @ error + 1e-3 * w.sum() * coef).max() < 1e-2 and abs(error.sum()) < 1e-2


def test_ordinal(spark):
    rnd = random.Random(3)
    grades = {0: ["###", "!!", "zz"], 1: ["mid", "zz", "ok"], 2: ["fine", "good", "ok"]}
    rows, ratings = [], []
    for i in range(900):
        g = rnd.randrange(3)
        rows.append((i, " ".join(rnd.choice(grades[g]) for _ in range(rnd.randint(5, 30))), "x", 0.0, 1))
        ratings.append((i, g))
    df, rated = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ratings, "doc_id long, grade int")
    model = ordinal_quality.fit(df, rated.where("doc_id % 5 <> 0"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in ordinal_quality.grade(df, model, 2).collect()}
    held = [(got[i], g) for i, g in ratings if i % 5 == 0]
    assert sum(r.grade == g for r, g in held) >= 0.95 * len(held)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r, _ in held)
    odd = spark.createDataFrame([(1, None, "x", 0.0, 1), (2, "", "x", 0.0, 1), (None, "good fine", "x", 0.0, 1), (3, "good " * 300_000, "x", 0.0, 1)], DOCS)
    assert ordinal_quality.grade(odd, model).count() == 4 and ordinal_quality.grade(odd.limit(0), model).count() == 0
    only = ordinal_quality.fit(df, rated.where("grade = 1"), 3)
    assert {(round(r.tail_probability), r.grade) for r in ordinal_quality.grade(odd, only).collect()} == {(1, 1)}
    assert ordinal_quality.grade(odd, ordinal_quality.fit(df, rated.limit(0), 3)).count() == 4


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    f = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3))
    assert np.allclose(ordinal_quality.minimise(f, rng.random(5)), 3, atol=1e-3)


@pytest.mark.parametrize("each", [5, 1000])
def test_balanced_sample(spark, each):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("k"))
    got = [r.doc_id for r in balanced(df, "k", each).collect()]
    assert len(got) <= 4 * each and got == [r.doc_id for r in balanced(df.repartition(7), "k", each).collect()]
    assert balanced(df.limit(0), "k", each).count() == 0
