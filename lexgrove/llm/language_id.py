"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (n from 1 to 3, blended)
present in both over the geometric mean of how many each has; presence is kept in
a hashed bit set.  A bounded sample of labelled texts gives Nystroem landmarks and
the one-versus-rest kernel ridge solution; a batch of texts is scored by two matrix
products, its presence matrix with the landmarks' and the kernel matrix with the
dual weights.

Texts are lower-cased; runs of anything but letters after a letter count as one space.  A null
text, or one without a letter, is `und` with score 0.  Rows without a language, or
without a doc_id, teach nothing.  With no labelled row at all every text is `und`.
Ties go to the language that sorts first.  Extra columns are ignored; repeated rows
are each scored; an empty table gives an empty result.
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
from .columns import small_batches, texts_of
from .samples import balanced, short_enough

LONGEST_GRAM, BITS = 3, 14
#: Labelled texts of each language that the model is fitted on, and landmarks among them.
SAMPLE_EACH, LANDMARKS = 600, 160
RIDGE, SHARPNESS = 1e-3, 3.0
#: Rows scored by one matrix product.
ROWS = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def presence(column: pa.Array) -> np.ndarray:
    """Texts by hashed n-grams: 1 where a text has the n-gram."""
    data, offsets = K.buffer_of(pc.utf8_lower(column))
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    first = offsets[:-1][offsets[:-1] < len(data)]
    keep[first] = letter[first]  # but not at the start of a text
    sums = np.append(0, np.cumsum(keep))
    data = np.where(letter, data, 32)[keep].astype(np.uint32)
    bounds = sums[offsets]
    out = np.zeros((len(offsets) - 1, 1 << BITS), bool)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) << BITS, np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))  # bytes from here to the text's end
    code = np.zeros(len(data), np.uint32)
    for n in range(1, LONGEST_GRAM + 1):
        code = code[: len(data) - n + 1] << np.uint32(8)
        code |= data[n - 1 :]
        if not len(code):
            break
        place = ((code + np.uint32(n * 0x1000193)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        inside = left[: len(code)] >= n
        flat[(row[: len(code)] + place)[inside]] = True
    return out


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _small(batch):
            packed = np.packbits(presence(part.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([x.tobytes() for x in packed], pa.binary())], ["doc_id", "lang", "bits"])


def _small(batch: pa.RecordBatch, text: str | int = "text") -> Iterator[pa.RecordBatch]:
    for part in K.slices(batch, text, 1 << 18):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def kernel(x: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Kernel matrix of presence rows against landmarks (columns, with the roots of their counts)."""
    x = x.astype(np.float32)
    own = np.sqrt(np.maximum(x.sum(axis=1), 1))
    return (x @ landmarks) / own[:, None] / norms


class Model:
    """Languages, packed landmarks and dual weights."""

    def __init__(self, langs: list[str], packed: np.ndarray, weights: np.ndarray):
        self.langs, self.packed, self.weights = langs, packed, weights
        self._columns = None

    def __getstate__(self):
        return self.langs, self.packed, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def columns(self):
        if self._columns is None:
            dense = np.unpackbits(self.packed, axis=1).astype(np.float32)
            self._columns = np.ascontiguousarray(dense.T), np.sqrt(np.maximum(dense.sum(axis=1), 1))
        return self._columns

    def scores(self, column: pa.Array) -> np.ndarray:
        """Texts by languages: kernel ridge scores, near 1 for a text's language and -1 for others."""
        return kernel(presence(column), *self.columns) @ self.weights


def fit(docs: DataFrame, sample_each: int = SAMPLE_EACH, landmarks: int = LANDMARKS) -> Model:
    """A model from the columns text and lang of all given rows (a bounded sample of each language)."""
    rows = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(short_enough() & F.expr("doc_id IS NOT NULL AND text RLIKE '\\\\p{L}'"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # texts become presence bits where they lie, so only those are put in order and sent
    got = balanced(rows, "lang", sample_each, made=lambda chosen: chosen.mapInArrow(_bits, f"doc_id {kind}, lang string, bits binary")).toArrow()
    lang, bits = got["lang"].to_pylist(), got["bits"].to_pylist()
    order = sorted(range(len(lang)), key=lambda i: (lang[i], bits[i]))
    langs = sorted(set(lang))
    if not langs:
        return Model([], np.zeros((0, (1 << BITS) // 8), np.uint8), np.zeros((0, 0), np.float32))
    packed = np.frombuffer(b"".join(bits[i] for i in order), np.uint8).reshape(len(order), -1)
    lang = [lang[i] for i in order]
    chosen = []
    for name in langs:  # as many landmarks of each language, spread over its sample
        own = [i for i, x in enumerate(lang) if x == name]
        many = min(len(own), max(1, landmarks // len(langs)))
        chosen += [own[k * len(own) // many] for k in range(many)]
    model = Model(langs, packed[chosen], np.zeros((0, 0), np.float32))
    gram = np.concatenate([kernel(np.unpackbits(packed[a : a + ROWS], axis=1), *model.columns) for a in range(0, len(packed), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(gram[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = gram @ root
    target = np.where(np.array(lang)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    share = np.array([1.0 / lang.count(x) for x in lang]) * len(lang) / len(langs)  # languages weigh the same
    ridge = np.linalg.solve(features.T @ (features * share[:, None]) + RIDGE * len(lang) * np.eye(features.shape[1]), features.T @ (target * share[:, None]))
    model.weights = (root @ ridge).astype(np.float32)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model, names: tuple[str, str], at: int, skip: int) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for part in _small(batch, at):
            text = pc.fill_null(part.column(at), "")
            if not model.langs:
                best, sure = np.full(len(text), "und", object), np.zeros(len(text))
            else:
                score = model.scores(text).astype(np.float64) * SHARPNESS
                soft = np.exp(score - score.max(axis=1, keepdims=True))
                sure = soft.max(axis=1) / soft.sum(axis=1)
                best = np.array(model.langs, object)[score.argmax(axis=1)]
                none = ~pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                best[none], sure[none] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*part.columns[skip:], pa.array(best.tolist(), pa.string()), pa.array(sure, pa.float64())], [*part.schema.names[skip:], *names])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns to keep, with the predicted language and its score (0 to 1) of each whole text, under the given names."""
    rows, schema, at, skip = texts_of(docs, keep)
    schema = StructType(list(schema)).add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(partial(_predict, model=docs.sparkSession.sparkContext.broadcast(model), names=names, at=at, skip=skip), schema).toDF(*keep, *names)
