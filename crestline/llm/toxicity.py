"""Toxicity: a convolutional text classifier in numpy with hashed word embeddings.

A word's embedding is the mean of rows of one hashed table: its whole spelling and its beginnings of several lengths,
so that inflections and compounds share parameters. Filters of several widths slide over the words of a whole text and
are max-pooled. As a filter is linear, its response is a sum of projections of the single words, computed once for
each distinct word of a batch. The score is calibrated so that 0.5 is the threshold of the text's language; the
language is guessed from the text's function words, never read from a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.training import SLICE, Adam, fit_temperature, labelled_sample, remainder, segments, sigmoid, text_batches, text_of_word, words_of

TRAIN_ROWS = 8000
TRAIN_CHARS = 100_000
BUCKETS = 1 << 17
DIM = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS = 6
#: small samples are passed over until so many rows were seen
UPDATES_ROWS = 40_000
TRIM = ".,;:!?\"'()[]*#%&$|"
#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in that is it for on was with be this are",
    "de": "der die und das den von zu ist im nicht ein mit dem sich auf",
    "fr": "le la les et des est une du dans qui pour pas sur avec par",
    "es": "el los y que las del por con una para su al lo como se",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def hash_words(words: pa.Array, buckets: int, prefixes: tuple[int, ...] = PREFIXES) -> np.ndarray:
    """(words, 1 + prefixes) rows of the table: of the whole word and of its first bytes; a short word repeats its own.

    Every byte of a word counts. Vectorised over the words' buffer; words of a text are no longer than MAX_WORD bytes.
    """
    n = len(words)
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None and n else np.zeros(1, np.uint8)
    size = np.diff(offsets)
    h = np.full(n, 1469598103934665603, np.uint64)
    out = np.zeros((n, 1 + len(prefixes)), np.uint64)
    done = np.zeros((n, len(prefixes)), bool)
    active = np.arange(n)
    for i in range(int(size.max(initial=0))):
        active = active[size[active] > i]
        h[active] = (h[active] ^ data[offsets[active] + i]) * np.uint64(1099511628211)
        if i + 1 in prefixes:
            k = prefixes.index(i + 1)
            out[active, 1 + k] = h[active] * np.uint64(2 * k + 3) + np.uint64(k + 1)
            done[active, k] = True
    out[:, 0] = h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(len(prefixes)):
        out[:, 1 + k] = np.where(done[:, k], out[:, 1 + k], out[:, 0])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return ((out ^ (out >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


class Model(NamedTuple):
    table: np.ndarray  # buckets, dim
    filters: dict[int, np.ndarray]  # width: (width, dim, filters)
    out: np.ndarray  # widths * filters
    bias: float
    thresholds: np.ndarray  # by language
    temperature: float


def _languages(numbers: np.ndarray, words: pa.Array, starts: np.ndarray) -> np.ndarray:
    """The language with most function words in each text; the last of LANGUAGES if there are none."""
    listed = [pa.array(x.split(), words.type) for x in FUNCTION_WORDS.values()]
    marks = np.stack([pc.is_in(words, value_set=x).to_numpy(zero_copy_only=False) for x in listed], axis=1).astype(np.int32)
    counts = np.zeros((len(starts) - 1, len(listed)), np.int64)
    owner = text_of_word(starts)
    for lo in range(0, len(numbers), SLICE * 32):
        at, who = segments(owner[lo : lo + SLICE * 32])
        counts[who] += np.add.reduceat(marks[numbers[lo : lo + SLICE * 32]], at, axis=0)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(listed))


def _pooled(model: Model, numbers: np.ndarray, words: pa.Array, starts: np.ndarray) -> np.ndarray:
    """(texts, widths * filters) maxima of the filters' positive responses over every window of each whole text."""
    # products in double precision, so that a word's response does not depend on the words that it is computed with
    vectors = model.table[hash_words(words, len(model.table))].mean(1).astype(np.float64)
    owner = text_of_word(starts)
    out = []
    for width, f in model.filters.items():
        projected = [(vectors @ f[j].astype(np.float64)).astype(np.float32) for j in range(width)]
        best = np.zeros((len(starts) - 1, f.shape[2]), np.float32)
        for lo in range(0, len(numbers) - width + 1, SLICE):
            hi = min(lo + SLICE, len(numbers) - width + 1)
            got = projected[0][numbers[lo:hi]]
            for j in range(1, width):
                got += projected[j][numbers[lo + j : hi + j]]
            if width > 1:
                got[owner[lo:hi] != owner[lo + width - 1 : hi + width - 1]] = 0.0
            at, who = segments(owner[lo:hi])
            best[who] = np.maximum(best[who], np.maximum.reduceat(got, at, axis=0))
        out.append(best)
    return np.concatenate(out, axis=1)


def logits_of(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    numbers, words, starts = words_of(texts, lower=True, trim=TRIM)
    pooled = _pooled(model, numbers, words, starts).astype(np.float64)
    return (pooled * model.out).sum(1) + model.bias, _languages(numbers, words, starts)


def score(model: Model, texts: pa.Array) -> np.ndarray:
    logits, languages = logits_of(model, texts)
    return np.round(sigmoid((logits - model.thresholds[languages]) / model.temperature), 9)


def fit(sample: list[tuple[str, int]], seed: int = 5, epochs: int = EPOCHS, buckets: int = BUCKETS, dim: int = DIM, n_filters: int = FILTERS, widths: tuple[int, ...] = WIDTHS) -> Model:
    """Train on a bounded sample; a fifth of it sets the thresholds by language and the temperature.

    With no rows or one class the score is constant: the class's, or one half.
    """
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in sample], np.float64)
    table = rng.normal(0, 0.05, (buckets, dim)).astype(np.float32)
    filters = {w: rng.normal(0, 0.5, (w, dim, n_filters)).astype(np.float32) for w in widths}
    out = (rng.choice([1.0, -0.3], len(widths) * n_filters, p=[0.75, 0.25]) * 0.5).astype(np.float32)
    none = Model(table[:1] * 0, {w: f * 0 for w, f in filters.items()}, out * 0, 0.0, np.zeros(len(LANGUAGES)), 1.0)
    if not len(y):
        return none
    if y.min() == y.max():
        return none._replace(bias=4.0 if y[0] else -4.0)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    numbers, words, starts = words_of(pa.array([t for t, _ in sample], pa.large_string()), lower=True, trim=TRIM)
    slots = hash_words(words, buckets)
    params = {f"f{w}": f for w, f in filters.items()} | {"out": out, "bias": np.zeros(1, np.float32)}
    adam, squares = Adam(params, 0.01), np.full(buckets, 1e-6, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    weight = np.minimum(weight, 8.0)
    for _ in range(max(epochs, -(-UPDATES_ROWS // max(1, len(train))))):
        rng.shuffle(train)
        for lo in range(0, len(train), 32):
            batch = train[lo : lo + 32]
            step = _step(table, slots, params, widths, *_batch(numbers, starts, batch), y[batch], weight[batch] / len(batch))
            if step is None:
                continue
            grads, hit, change = step
            adam.update(grads)
            if len(hit):
                flat, at = np.unique(hit, return_inverse=True)
                change = np.repeat(change / hit.shape[1], hit.shape[1], axis=0)
                total = np.stack([np.bincount(at.ravel(), change[:, d], len(flat)) for d in range(dim)], axis=1).astype(np.float32)
                squares[flat] += (total**2).mean(1)
                table[flat] -= 0.1 * total / np.sqrt(squares[flat])[:, None]
    model = Model(table, {w: params[f"f{w}"] for w in widths}, params["out"], float(params["bias"][0]), np.zeros(len(LANGUAGES)), 1.0)
    fit_on = held if len(held) >= 40 and y[held].min() != y[held].max() else order
    logits, languages = logits_of(model, pa.array([sample[i][0] for i in fit_on], pa.large_string()))
    every = _threshold(logits, y[fit_on])
    thresholds = np.array([_threshold(logits[languages == k], y[fit_on][languages == k], every) for k in range(len(LANGUAGES))])
    return model._replace(thresholds=thresholds, temperature=fit_temperature(logits - thresholds[languages], y[fit_on]))


def _batch(numbers: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts one after the other, and how many each has."""
    size = starts[texts + 1] - starts[texts]
    return numbers[np.repeat(starts[texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _step(table: np.ndarray, slots: np.ndarray, params: dict[str, np.ndarray], widths: tuple[int, ...], ids: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray] | None:
    """Gradients of a batch of texts: of the parameters, and of the embeddings that the maxima came from (slots, steps)."""
    full = size > 0
    size, y, weight = size[full], y[full], weight[full]
    if not len(size):
        return None
    distinct, local = np.unique(ids, return_inverse=True)
    vectors = table[slots[distinct]].mean(1)
    owner, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    n_filters = params[f"f{widths[0]}"].shape[2]
    pooled, place = [], []
    for w in widths:
        f = params[f"f{w}"]
        top, at = np.zeros((len(size), n_filters), np.float32), np.full((len(size), n_filters), -1)
        n = len(ids) - w + 1
        if n > 0:
            got = (vectors @ f[0])[local[:n]]
            for j in range(1, w):
                got += (vectors @ f[j])[local[j : j + n]]
            got[owner[:n] != owner[w - 1 :]] = -np.inf
            some = np.flatnonzero(size >= w)
            first = begin[begin < n]
            best = np.maximum.reduceat(got, first, axis=0)
            here = np.where(got == best[owner[:n]], np.arange(n)[:, None], n)
            at[some] = np.minimum.reduceat(here, first, axis=0)[some]
            top[some] = best[some]
        pooled.append(np.maximum(top, 0))
        place.append(at)
    pooled = np.concatenate(pooled, axis=1)
    error = ((sigmoid(pooled @ params["out"] + params["bias"][0]) - y) * weight).astype(np.float32)
    back = error[:, None] * params["out"] * (pooled > 0)
    grads = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
    rows, steps = [], []
    for k, w in enumerate(widths):
        f, at = params[f"f{w}"], place[k]
        g = back[:, k * n_filters : (k + 1) * n_filters] * (at >= 0)
        grads[f"f{w}"] = np.zeros_like(f)
        for j in range(w):
            touched = local[np.maximum(at, 0) + j * (at >= 0)]
            grads[f"f{w}"][j] = np.einsum("nfd,nf->df", vectors[touched], g)
            moved = np.nonzero(g)
            rows.append(slots[distinct[touched[moved]]])
            steps.append(f[j].T[moved[1]] * g[moved][:, None])
    return grads, np.concatenate(rows), np.concatenate(steps)


def _threshold(logits: np.ndarray, y: np.ndarray, otherwise: float = 0.0) -> float:
    """The middle of the gap with fewest errors; ``otherwise`` where a language has too few rows of a class."""
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return otherwise
    order = np.argsort(logits)
    wrong = np.concatenate([[0], np.cumsum(y[order])]) + np.concatenate([np.cumsum((1 - y[order])[::-1])[::-1], [0]])
    least = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[logits.min() - 1], np.sort(logits), [logits.max() + 1]])
    gaps = (edges[least + 1] - edges[least]).argmax()
    return float((edges[least[gaps]] + edges[least[gaps] + 1]) / 2)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Fitted on at most train_rows labelled rows that are not held out. Null and empty texts get the score of a text
    without words; a null id counts as not held out; repeated rows stay; other columns are not read. The model has a
    fixed size and is broadcast.
    """
    model = fit(labelled_sample(docs, labels, label, divisor, held, train_rows, train_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(shared.value, texts) for texts in text_batches(batch.column(2))]
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", divisor) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")
