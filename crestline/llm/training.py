"""What the two text classifiers share: labelled samples of bounded size, and words of Arrow batches as integer arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import discard, materialise

#: bytes of the labelled texts that a classifier is fitted on
SAMPLE_BYTES = 48 << 20
#: longer words, in bytes, are cut into pieces: joined text, and scripts that do not part words
MAX_WORD, PIECE = 64, 16
#: words that are gathered at once, whatever the length of a text
SLICE = 1 << 14


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text modulo divisor; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int, rows: int, max_chars: int, max_bytes: int = SAMPLE_BYTES, seed: int = 17) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs, of at most max_bytes in all, from labelled rows that are not held out.

    The same on every run: ids are taken in the order of a hash, as far as they are labelled and have a text of at most
    max_chars characters, until there are ``rows`` or the next one would not fit. An id labelled twice takes its largest
    label, null labels are none; of several texts of an id the smallest one is taken, a null text is empty. Ids go to
    the executors ``rows`` at first and twice as many whenever too few of them had texts; what is found is written, one row
    an id, and only the rows that are chosen reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    known = known.where(remainder("doc_id", divisor) != held).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).where(F.length("_t") <= max_chars)
    want = rows
    while True:
        chosen = known.orderBy("_h", "doc_id").limit(want)
        found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y", "_h").agg(F.min("_t").alias("_t"))
        found = materialise(found.withColumn("_b", F.octet_length("_t").cast("long")), "labelled")
        sizes = found.select("_h", "doc_id", "_b").toArrow().sort_by([("_h", "ascending"), ("doc_id", "ascending")])
        if len(sizes) >= rows or known.limit(want + 1).count() <= want:
            break
        discard(found)
        want *= 2
    fits = np.cumsum(sizes["_b"].to_numpy())[:rows] <= max_bytes
    n = int(fits.sum())
    if n:
        last_h, last_id = sizes["_h"][n - 1].as_py(), sizes["doc_id"][n - 1].as_py()
        found = found.where((F.col("_h") < last_h) | ((F.col("_h") == last_h) & (F.col("doc_id") <= F.lit(last_id))))
        table = found.select("_h", "doc_id", "_t", "_y").toArrow().sort_by([("_h", "ascending"), ("doc_id", "ascending")])
    discard(found)
    rows = list(zip(table["_t"].to_pylist(), table["_y"].to_pylist(), strict=True)) if n else []
    table = sizes = None
    pa.default_memory_pool().release_unused()  # the driver's memory is small beside what passed through it
    return rows


def text_batches(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[pa.Array]:
    """The column in runs of whole texts of about most_bytes, null as empty; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(column):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield column.slice(lo, hi - lo)
        lo = hi


def pieces(word: str) -> list[str]:
    """A long word's parts, all of it: single characters of scripts that do not part words, else runs of PIECE characters."""
    return _PIECES.findall(word)


_PIECES = re.compile(rf"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uD7FF\uF900-\uFAFF\U00020000-\U0003FFFF]|.{{1,{PIECE}}}?(?=[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uD7FF\uF900-\uFAFF\U00020000-\U0003FFFF])|.{{1,{PIECE}}}", re.S)


def words_of(texts: pa.Array, lower: bool, trim: str | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word numbers, distinct words, starts of texts with one end more): white space splits, in C++ throughout.

    A word of over MAX_WORD bytes stands for its pieces, so that no word that is left is longer.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    if trim:
        flat = pc.utf8_trim(flat, trim)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    keep = size > 0
    if not keep.all():
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        flat, size = flat.filter(pa.array(keep)), size[keep]
    long = size > MAX_WORD
    if long.any():
        parts = [pieces(w) for w in flat.filter(pa.array(long)).to_pylist()]
        times = np.ones(len(flat), np.int64)
        times[long] = [len(x) for x in parts]
        place = np.concatenate([[0], np.cumsum(times)])
        where = np.repeat(np.arange(len(flat)), times)
        new = np.repeat(long, times)
        where[new] = len(flat) + np.arange(int(new.sum()))
        flat = pa.concat_arrays([flat, pa.array([x for p in parts for x in p], flat.type)]).take(pa.array(where))
        starts = place[starts]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, starts


def text_of_word(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def segments(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal owners, and the owner of each run."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return at, owner[at]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises log loss, by golden section over its logarithm."""
    if not len(y) or y.min() == y.max():
        return 1.0

    def loss(log_t: float) -> float:
        p = np.clip(sigmoid(logits / np.exp(log_t)), 1e-12, 1 - 1e-12)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    lo, hi, g = -1.5, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)
