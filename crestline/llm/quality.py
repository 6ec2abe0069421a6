"""Quality: random-indexing word vectors pooled per document, and a two-layer numpy network with calibrated scores.

Every unit has a sparse ternary index vector drawn from a hash of its name. A unit is a frequent word, else the shape
of a rare one (runs of capitals, small letters, digits, and its punctuation), else a repeat of the word before it. Its
context vector is the sum of the index vectors of its neighbours over the training texts. A document is the mean of
its units' vectors, own and context, over its whole text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.training import SLICE, Adam, fit_temperature, labelled_sample, remainder, segments, sigmoid, text_batches, text_of_word, words_of

TRAIN_ROWS = 5000
TRAIN_CHARS = 100_000
#: bytes of text whose words are held at once while fitting
FIT_BYTES = 1 << 20
DIM = 48
NONZERO = 4
WINDOW = 2
MAX_UNITS = 4096
MIN_COUNT = 20
HIDDEN = 24
UPDATES_ROWS = 120_000

#: runs of capitals, of other letters and of digits, each with the mark that stands for it and the mark's name
_MARKS = (("[A-ZÀ-ÖØ-Þ]+", "\x01", "A"), (r"[\p{L}\p{Nl}\p{No}]+", "\x02", "a"), (r"\p{Nd}+", "\x03", "9"))
_NAMES = str.maketrans({mark: name for _, mark, name in _MARKS})
_RUN = re.compile(r"([^\w\s])\1+")


def shapes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(number of each word's shape, the shapes): short names for how words are written, A, a and 9 for runs of capitals,
    small letters and digits, and of equal signs two at most. Words are rewritten in C++, Python sees distinct shapes only."""
    for pattern, mark, _ in _MARKS:
        words = pc.replace_substring_regex(words, pattern=pattern, replacement=mark)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [_RUN.sub(r"\1\1", x).translate(_NAMES) for x in coded.dictionary.to_pylist()]


def shape(word: str) -> str:
    return shapes(pa.array([word], pa.large_string()))[1][0]


def index_vector(unit: str, dim: int = DIM) -> np.ndarray:
    """Sparse and ternary, from a hash of the unit's name alone."""
    out = np.zeros(dim, np.float32)
    for i in range(NONZERO):
        h = xxhash.xxh64_intdigest(unit.encode(), i + 1)
        out[h % dim] += 1.0 if h >> 40 & 1 else -1.0
    return out


class Model(NamedTuple):
    units: dict[str, int]
    vectors: np.ndarray  # units + 1, 2 * dim; the last is for unknown shapes
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float


REPEAT = "<repeat>"


def _units_of(words: pa.Array, units: dict[str, int]) -> np.ndarray:
    out = np.array([units.get(w, -1) for w in words.to_pylist()], np.int64)
    rare = out < 0
    if rare.any():
        of_word, names = shapes(words.filter(pa.array(rare)))
        out[rare] = np.array([units.get("shape " + x, len(units)) for x in names], np.int64)[of_word]
    return out


def _numbers(numbers: np.ndarray, starts: np.ndarray, of_word: np.ndarray, repeat: int) -> np.ndarray:
    """Unit of every word; a word equal to the one before it in the same text is the repeat unit."""
    out = of_word[numbers] if len(numbers) else np.zeros(0, np.int64)
    same = np.zeros(len(out), bool)
    same[1:] = numbers[1:] == numbers[:-1]
    same[starts[:-1][starts[:-1] < len(out)]] = False
    out[same] = repeat
    return out


def _pool(vectors: np.ndarray, of_position: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean vector of each text, zero without words, summed in slices so that long texts need no more memory."""
    out = np.zeros((len(starts) - 1, vectors.shape[1]))
    owner = text_of_word(starts)
    for lo in range(0, len(of_position), SLICE):
        at, who = segments(owner[lo : lo + SLICE])
        out[who] += np.add.reduceat(vectors[of_position[lo : lo + SLICE]], at, axis=0)
    return out / np.maximum(np.diff(starts), 1)[:, None]


def features(model: Model, texts: pa.Array) -> np.ndarray:
    numbers, words, starts = words_of(texts, lower=False, trim=None)
    return _pool(model.vectors, _numbers(numbers, starts, _units_of(words, model.units), model.units[REPEAT]), starts)


def _logits(model: Model, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = model.layers
    return np.tanh((x - model.mean) / model.scale @ w1 + b1) @ w2 + b2[0]


def score(model: Model, texts: pa.Array) -> np.ndarray:
    return np.round(sigmoid(_logits(model, features(model, texts)) / model.temperature), 9)


def word_vectors(texts: pa.Array, dim: int = DIM, max_units: int = MAX_UNITS, min_count: int = MIN_COUNT) -> tuple[dict[str, int], np.ndarray]:
    """Units of the texts and their vectors: own index vector, and the normalised sum of the neighbours' ones."""
    count: Counter[str] = Counter()
    for part in text_batches(texts, FIT_BYTES):
        numbers, words, _ = words_of(part, lower=False, trim=None)
        count.update(dict(zip(words.to_pylist(), np.bincount(numbers, minlength=len(words)).tolist(), strict=True)))
    top = heapq.nsmallest(max_units // 2, ((-n, w) for w, n in count.items() if n >= min_count))
    units = {REPEAT: 0}
    for _, w in top:
        units.setdefault(w, len(units))
    rare = [w for w in count if w not in units]
    of_word, names = shapes(pa.array(rare, pa.large_string()))
    times = np.bincount(of_word, np.array([count[w] for w in rare], np.float64), len(names))
    found: Counter[str] = Counter()
    for name, n in zip(names, times.tolist(), strict=True):
        found["shape " + name] += n
    count.clear()
    for s, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: max_units // 2]:
        units.setdefault(s, len(units))
    n = len(units) + 1
    own = np.stack([index_vector(u, dim) for u in (*units, "<unknown>")])
    context = np.zeros((n, dim))
    for part in text_batches(texts, FIT_BYTES):
        numbers, words, starts = words_of(part, lower=False, trim=None)
        of_position, owner = _numbers(numbers, starts, _units_of(words, units), units[REPEAT]), text_of_word(starts)
        for step in range(1, WINDOW + 1):
            a, b = of_position[:-step], of_position[step:]
            inside = owner[:-step] == owner[step:]
            pairs, times = np.unique(a[inside] * n + b[inside], return_counts=True)
            left, right = np.divmod(pairs, n)
            np.add.at(context, left, own[right] * times[:, None])
            np.add.at(context, right, own[left] * times[:, None])
    context /= np.maximum(np.linalg.norm(context, axis=1), 1e-9)[:, None]
    return units, np.concatenate([own, context], axis=1)  # double, so that sums do not depend on slices


def fit(sample: list[tuple[str, int]], seed: int = 11, hidden: int = HIDDEN, dim: int = DIM) -> Model:
    """Word vectors and network from a bounded sample; a fifth of it only sets the temperature.

    With no rows or one class the score is constant: the class's, or one half.
    """
    rng = np.random.default_rng(seed)
    texts = pa.array([t for t, _ in sample], pa.large_string())
    y = np.array([v for _, v in sample], np.float64)
    units, vectors = word_vectors(texts, dim)
    size = vectors.shape[1]
    layers = {"w1": rng.normal(0, size**-0.5, (size, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1)}
    model = Model(units, vectors, np.zeros(size), np.ones(size), tuple(layers.values()), 1.0)
    if not len(y) or y.min() == y.max():
        layers["w2"][:] = 0
        layers["b2"][:] = 0 if not len(y) else 4.0 if y[0] else -4.0
        return model
    x = np.concatenate([features(model, part) for part in text_batches(texts, FIT_BYTES)])
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    z, adam = (x - mean) / scale, Adam(layers, 0.005)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    weight = np.minimum(weight, 8.0)
    for _ in range(-(-UPDATES_ROWS // len(train))):
        rng.shuffle(train)
        for lo in range(0, len(train), 64):
            i = train[lo : lo + 64]
            h = np.tanh(z[i] @ layers["w1"] + layers["b1"])
            error = (sigmoid(h @ layers["w2"] + layers["b2"][0]) - y[i]) * weight[i] / len(i)
            back = np.outer(error, layers["w2"]) * (1 - h * h)
            adam.update({"w1": z[i].T @ back + 1e-4 * layers["w1"], "b1": back.sum(0), "w2": h.T @ error + 1e-4 * layers["w2"], "b2": error.sum(keepdims=True)})
    model = model._replace(mean=mean, scale=scale)
    fit_on = held if len(held) >= 40 and y[held].min() != y[held].max() else order
    return model._replace(temperature=fit_temperature(_logits(model, x[fit_on]), y[fit_on]))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Fitted on at most train_rows labelled rows that are not held out. Null and empty texts get the score of a text
    without words; a null id counts as not held out; repeated rows stay; other columns are not read. The model has a
    bounded size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label, divisor, held, train_rows, train_chars))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(shared.value, texts) for texts in text_batches(batch.column(2))]
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", divisor) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    return fit(labelled_sample(docs, labels, label, divisor, held, train_rows, train_chars))


def reject_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, docs_for_fit: DataFrame | None = None, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least ``threshold``; fitted on docs_for_fit if given.

    Null and empty texts score like a text without words and stay or go together. Repeated rows and null ids are rows
    like any other, and other columns, whatever their names, are neither read nor changed. Without labels every text scores one
    half. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs if docs_for_fit is None else docs_for_fit, labels, train_rows=train_rows, train_chars=train_chars))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(shared.value, texts) for texts in text_batches(batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(scan, docs.schema)
