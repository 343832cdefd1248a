"""Toxicity by weak supervision.

1. Voters are mined from labelled rows: words and word beginnings (4 to 8 bytes)
   far likelier in texts marked toxic.  Each votes toxic where it occurs and
   abstains elsewhere; pattern voters count how many lexicon entries a text has and
   how dense they are, and vote either way.
2. A generative label model (two hidden classes; within a class the votes form a forest
   in which each voter depends on the class and on its parent's vote) is fitted to the
   votes by expectation maximisation: voters' accuracies and their correlations are its
   parameters, and copies of one voice count once.
3. A linear classifier over words and word beginnings is trained on the posterior
   labels, and scores every whole text.

Labels are used to mine the lexicon, and a row's own label is one more voter, of the
stated accuracy RATER, which keeps the hidden classes from drifting; accuracies and
correlations of all others are estimated from the votes.  The sample of labelled rows is bounded; nothing else is.

A null or empty text has no features and its score is the classifier's bias.  Rows
without a label, or without a doc_id, teach nothing.  If one label value is missing,
every score is 0.  Repeated rows are each scored.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as K
from .columns import texts_of
from .decontamination import WORD_TABLE
from .samples import balanced, labelled_texts

#: Labelled texts of each class in the sample, voters and classifier features at most.
SAMPLE_EACH, VOTERS, FEATURES = 2500, 150, 400
BEGINNINGS = (4, 5, 6, 7, 8)
TALLY_BITS = 20
#: Twice n times a dependency beyond this is no chance (chi-square, eight degrees of freedom, 1 in 1000); rounds that draw the forest.
CHANCE, REDRAWN = 13.0, (0, 2, 5, 9)
#: The accuracy of a row's own label.
RATER = 0.9
#: Least share of a voter's information that a dependency has.
LEAST_SHARE = 0.2
THRESHOLD = 0.7


class Counts:
    """Distinct features of each text of a column: row, feature hash, times; and each text's words."""

    def __init__(self, column: pa.Array, wanted: np.ndarray | None = None):
        data, offsets = K.buffer_of(pc.utf8_lower(column))
        words = K.tokenize(data, offsets, WORD_TABLE)
        self.words = np.diff(words.bounds)
        size = words.ends - words.starts
        padded = np.append(data, np.zeros(8, np.uint8))
        code = np.zeros(len(size), np.uint64)
        row = np.repeat(np.arange(len(self.words), dtype=np.int64), self.words)
        found = [self._of(row, words.hashes, wanted)]
        for k in range(max(BEGINNINGS)):
            code |= padded[words.starts + k].astype(np.uint64) << np.uint64(8 * k)
            if k + 1 in BEGINNINGS:
                long = np.flatnonzero(size > k + 1)
                with np.errstate(over="ignore"):
                    found.append(self._of(row[long], K.mix(code[long] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)), wanted))
        self.row = np.concatenate([r for r, _, _ in found])
        self.feature = np.concatenate([f for _, f, _ in found])
        self.times = np.concatenate([n for _, _, n in found])

    @staticmethod
    def _of(row, hashes, wanted):
        if wanted is not None:
            table = _table(wanted)
            maybe = np.flatnonzero(table[(hashes >> np.uint64(44)).astype(np.int64)])
            place = np.searchsorted(wanted, hashes[maybe])
            place[place == len(wanted)] = 0
            hit = wanted[place] == hashes[maybe] if len(wanted) else np.zeros(0, bool)
            row, hashes = row[maybe[hit]], hashes[maybe[hit]]
        order = np.argsort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)), kind="stable")
        row, hashes = row[order], hashes[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, np.int64)
        return row[first], hashes[first], np.diff(np.append(first, len(row)))


def tally_place(feature: np.ndarray, table: int) -> np.ndarray:
    """Where a feature is counted in the first or second table."""
    return ((feature >> np.uint64(64 - TALLY_BITS * (1 + table))) & np.uint64((1 << TALLY_BITS) - 1)).astype(np.int64)


class Kept:
    """The counts of several columns together, of the features that are worthy in either table.

    A rare feature that shares its place with a common one in one table hardly does so
    in the other.
    """

    def __init__(self, chunks: list[pa.Array], worthy: np.ndarray):
        rows, features, times, words, first = [], [], [], [], 0
        for chunk in chunks:
            own = Counts(chunk)
            keep = worthy[0][tally_place(own.feature, 0)] | worthy[1][tally_place(own.feature, 1)]
            rows.append(own.row[keep] + first)
            features.append(own.feature[keep])
            times.append(own.times[keep])
            words.append(own.words)
            first += len(chunk)
        self.row, self.feature, self.times, self.words = (np.concatenate(x) for x in (rows, features, times, words))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(wanted: np.ndarray) -> np.ndarray:
    held = _tables.get(0)
    if held is None or held[0] is not wanted:
        table = np.zeros(1 << 20, bool)
        table[(wanted >> np.uint64(44)).astype(np.int64)] = True
        _tables[0] = held = (wanted, table)
    return held[1]


def vote_matrix(counts: Counts, voters: np.ndarray) -> np.ndarray:
    """Texts by voters: 1 toxic, -1 clean, 0 no vote; lexicon voters first, then the pattern voters."""
    n = len(counts.words)
    place = np.searchsorted(voters, counts.feature)
    place[place == len(voters)] = 0
    hit = voters[place] == counts.feature
    lexicon = np.zeros((n, len(voters)), np.int8)
    lexicon[counts.row[hit], place[hit]] = 1
    distinct = lexicon.sum(axis=1, dtype=np.int64)
    times = np.bincount(counts.row[hit], counts.times[hit], n)
    density = times / np.maximum(counts.words, 1)
    patterns = [np.where(distinct == 0, -1, 0), np.where(distinct >= 2, 1, -1), np.where(distinct >= 4, 1, 0), np.where(times >= 3, 1, 0), np.where(density >= 0.02, 1, -1), np.where(density >= 0.005, 1, 0)]
    return np.column_stack([lexicon, *patterns]).astype(np.int8)


def _dependencies(votes: np.ndarray, beliefs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each voter's parent (-1: none) in the forest of strongest dependencies within the classes.

    A dependency is the voters' mutual information given the class.  Those that chance
    explains are left out, and those below LEAST_SHARE of what either voter says at all:
    while the classes are not yet known, they show through as weak dependencies.  Of the
    rest a maximum spanning forest stays.
    """
    n, m = votes.shape
    flat = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float32).reshape(n, -1)
    shared, said = np.zeros((m, m)), np.zeros(m)
    for belief in beliefs:
        joint = ((flat * belief[:, None].astype(np.float32)).T @ flat).astype(np.float64) / n
        alone = np.diag(joint)
        expected = np.outer(alone, alone) / max(1e-12, belief.sum() / n)
        said -= (alone * np.log(np.maximum(alone, 1e-12) / max(1e-12, belief.sum() / n))).reshape(m, 3).sum(axis=1)
        shared += np.where(joint > 1e-9, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12)), 0).reshape(m, 3, m, 3).sum(axis=(1, 3))
    i, j = np.triu_indices(m, 1)
    order = np.argsort(-shared[i, j], kind="stable")
    group, near = list(range(m)), [[] for _ in range(m)]

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    strong = shared[i, j] > np.maximum(CHANCE / n, LEAST_SHARE * np.minimum(said[i], said[j]))
    for k in order[strong[order]].tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            group[a] = b
            near[i[k]].append(int(j[k]))
            near[j[k]].append(int(i[k]))
    parent, seen = np.full(m, -1), np.zeros(m, bool)
    for root in range(m):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            v = todo.pop()
            for w in near[v]:
                if not seen[w]:
                    seen[w], parent[w] = True, v
                    todo.append(w)
    return parent


def _vote_tables(votes: np.ndarray, parent: np.ndarray, belief: np.ndarray) -> np.ndarray:
    """Log P(vote | parent's vote) in a class: voters by parent's votes by votes (in order -1, 0, 1).

    Counts are smoothed towards the voter's own distribution in the class, and that towards
    an even one.
    """
    n, m = votes.shape
    cell = _cells(votes, parent)
    held = np.bincount(cell.ravel(), np.broadcast_to(belief[:, None], cell.shape).ravel(), 9 * m).reshape(m, 3, 3)
    own = held.sum(axis=1) + 0.3
    own /= own.sum(axis=1, keepdims=True)
    return np.log((held + own[:, None, :]) / (held.sum(axis=2, keepdims=True) + 1))


def _cells(votes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    above = np.where(parent >= 0, votes[:, parent] + 1, 0)
    return (np.arange(votes.shape[1]) * 3 + above) * 3 + votes + 1


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, told: np.ndarray | float = 0.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each text, evidence tables, each voter's parent).

    The generative model: a hidden class, and voters whose votes given the class form a
    forest, P(votes | class) = product of P(vote | parent's vote, class).  Accuracies and
    correlations are its parameters; both are estimated from the votes by expectation
    maximisation, and start only says which class is toxic.  told is what a voter of known
    accuracy adds to each text's log odds.  evidence[j, a, b] is what
    voter j's vote b adds to the log odds where its parent votes a (roots: a is 0).  The
    forest is drawn anew in the first rounds and then kept, so that the likelihood rises
    from there on.
    """
    votes = votes.astype(np.int64)
    posterior = start.astype(np.float64)
    parent = np.full(votes.shape[1], -1)
    for k in range(rounds):
        beliefs = (1 - posterior, posterior)
        if k in REDRAWN:
            parent = _dependencies(votes, beliefs)
        evidence = _vote_tables(votes, parent, beliefs[1]) - _vote_tables(votes, parent, beliefs[0])
        logit = evidence.ravel()[_cells(votes, parent)].sum(axis=1) + np.log(prior / (1 - prior)) + told
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if k > max(REDRAWN) and np.abs(posterior - before).max() < 1e-6:
            break
    return posterior, evidence, parent


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6) * weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ ((p - y) * weight) + penalty * w)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


class Model:
    """Sorted feature hashes with weights, and a bias; None where nothing could be learnt."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float | None):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(column))
        counts = Counts(column, self.features)
        logit = self.bias + np.bincount(counts.row, self.weights[np.searchsorted(self.features, counts.feature)], len(column))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_each: int = SAMPLE_EACH) -> Model:
    """A model from documents (doc_id, text) and their 0/1 labels (doc_id, label); a bounded sample of each class.

    The sample is drawn from the labels alone, so only its rows' ids are joined to the
    documents: 2 * sample_each * 2 ids at most, which are broadcast.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    natural = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = balanced(marked, "label", sample_each).collect()
    if len(natural) < 2 or not chosen:
        return nothing()
    texts, marks = labelled_texts(docs, chosen, "label")
    y = np.array(marks, np.float64)
    return learn(texts, y, natural) if 0 < y.sum() < len(y) else nothing()


def nothing() -> "Model":
    return Model(np.zeros(0, np.uint64), np.zeros(0), None)


def learn(texts: pa.Array, y: np.ndarray, natural: dict[int, int]) -> Model:
    """The model of a sample; natural: how many of all labelled rows have each label."""
    chunks = [texts.slice(at, 256) for at in range(0, len(texts), 256)]
    labels = [y[at : at + 256] for at in range(0, len(texts), 256)]
    least = max(2, int(0.002 * y.sum()))
    # a first pass counts hashed features by label in two small tables, so that the second keeps few of them
    tallies = np.zeros((2, 2, 1 << TALLY_BITS), np.uint32)
    for chunk, own in zip(chunks, labels):
        seen = Counts(chunk)
        for table in (0, 1):
            place = tally_place(seen.feature, table)
            for label in (0, 1):
                tallies[table, label] += np.bincount(place[own[seen.row] == label], minlength=1 << TALLY_BITS).astype(np.uint32)
    rates = (tallies + np.float32(0.5)) / np.array([(1 - y).sum() + 1, y.sum() + 1], np.float32)[None, :, None]
    worthy = (tallies[:, 1] >= least) & (rates[:, 1] > 1.8 * rates[:, 0])
    del tallies, rates
    counts = Kept(chunks, worthy)
    unique, inverse = np.unique(counts.feature, return_inverse=True)
    toxic = np.bincount(inverse, y[counts.row], len(unique))
    clean = np.bincount(inverse, 1 - y[counts.row], len(unique))
    base = y.mean()
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    worth = np.where((toxic >= least) & (odds > 2.7), odds * np.sqrt(toxic), 0)
    best = np.argsort(-worth, kind="stable")[:VOTERS]
    voters = np.sort(unique[best[worth[best] > 0]])
    if not len(voters):
        return nothing()
    votes = vote_matrix(counts, voters)
    start = np.where(votes[:, : len(voters)].any(axis=1), 0.9, 0.05)
    posterior, _, _ = label_model(votes, base, start, np.where(y == 1, 1, -1) * np.log(RATER / (1 - RATER)))
    # features that the posterior labels set apart
    p = np.bincount(inverse, posterior[counts.row], len(unique))
    q = np.bincount(inverse, 1 - posterior[counts.row], len(unique))
    lift = np.log((p + 0.5) / (posterior.sum() + 1)) - np.log((q + 0.5) / ((1 - posterior).sum() + 1))
    strength = np.where((p + q >= least) & (lift > 0.7), lift * np.sqrt(p), 0)
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[strength[chosen] > 0])
    place = np.full(len(unique), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)))
    use = place[inverse] >= 0
    x[counts.row[use], place[inverse][use]] = 1
    # classes weigh as they occur among all labelled rows
    share = np.where(y == 1, natural[1] / max(1, y.sum()), natural[0] / max(1, (1 - y).sum()))
    weights, bias = logistic(x, posterior, share, ridge=1e-5)
    return Model(unique[chosen], weights, bias)


def _score(batches: Iterator[pa.RecordBatch], model, name: str, at: int, skip: int) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for part in K.slices(batch, at, 1 << 19):
            yield pa.RecordBatch.from_arrays([*part.columns[skip:], pa.array(model.scores(pc.fill_null(part.column(at), "")), pa.float64())], [*part.schema.names[skip:], name])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns to keep, with the score (0 to 1) of each whole text under the given name."""
    rows, schema, at, skip = texts_of(docs, keep)
    return rows.mapInArrow(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model), name=name, at=at, skip=skip), StructType(list(schema)).add(name, "double")).toDF(*keep, name)
