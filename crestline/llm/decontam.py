"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles, to the next power of two. For a partition of size u each
document is cut into blocks of u shingles, so that a short item meets pieces of a long document of about its own size
and their Jaccard similarity stays well above zero however long the document is. A block and an item that agree on one
of the MinHash values are candidates; the item's distinct shingles that occur anywhere in the whole document are then
counted word by word.

However many items there are, documents are read and hashed once: distinct item texts are dealt into indexes of bounded
size, each a broadcast of its own, and a task holds one of them at a time against the minima of a slice of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crestline.llm.common import ALNUM, byte_texts, materialise

NGRAM = 5
THRESHOLD = 0.8
HASHES = 32
ITEMS_AT_ONCE = 20_000
ITEM_BYTES_AT_ONCE = 32 << 20
_BASE = 0x9E3779B97F4A7C15
_SLICE_WORDS = 1 << 19


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z (lower-cased), a-z, 0-9 and characters beyond ASCII."""
    return text.translate(ALNUM).split()


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """Space-joined runs of n words; fewer words are one shingle, none are none."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, from one hash of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + w[i : i + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(k)
    a, b = (int(x) for x in rng.integers(1 << 62, size=2))
    return (h ^ np.uint64(b)) * np.uint64(2 * a + 1)


class Index(NamedTuple):
    ids: list
    texts: list[bytes]  # words of each item, joined by a space
    counts: np.ndarray  # distinct shingles of each
    hashes: np.ndarray  # of all items, sorted within each
    starts: np.ndarray
    partitions: dict[int, tuple[np.ndarray, np.ndarray]]  # size: for each hash function sorted values and their items


def build_index(items: list[tuple], ngram: int = NGRAM, hashes: int = HASHES) -> Index:
    """The index of (id, text) items; those without words match nothing and are left out."""
    ids, texts, counts, hashed = [], [], [], []
    by_size: dict[int, list[int]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        if words:
            n = len(set(shingles_of(words, ngram)))
            by_size.setdefault(1 << (n - 1).bit_length(), []).append(len(ids))
            ids.append(item)
            texts.append(b" ".join(words))
            counts.append(n)
            hashed.append(np.unique(shingle_hashes(words, ngram)))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in hashed])]).astype(np.int64)
    partitions = {}
    for size, members in sorted(by_size.items()):
        values, where = np.zeros((hashes, len(members)), np.uint64), np.zeros((hashes, len(members)), np.int32)
        for k in range(hashes):
            low = np.array([_permuted(hashed[i], k).min() for i in members], np.uint64)
            order = np.argsort(low, kind="stable")
            values[k], where[k] = low[order], np.array(members)[order]
        partitions[size] = values, where
    return Index(ids, texts, np.array(counts, np.int64), np.concatenate([np.zeros(0, np.uint64), *hashed]), starts, partitions)


class Minima(NamedTuple):
    """MinHash values of the blocks of some documents, for each size and hash function, and the document of each block."""

    values: dict[tuple[int, int], np.ndarray]
    owners: dict[int, np.ndarray]


def block_minima(h: np.ndarray, starts: np.ndarray, sizes: list[int], hashes: int = HASHES) -> Minima:
    """h: shingle hashes of documents that begin at starts; sizes are powers of two in rising order."""
    size_of, begins, owners = np.diff(starts), {}, {}
    for size in sizes:
        of_document = -(-size_of // size)
        owner = np.repeat(np.arange(len(size_of)), of_document)
        first = np.cumsum(of_document) - of_document
        begins[size], owners[size] = starts[owner] + (np.arange(len(owner)) - first[owner]) * size, owner
    values = {}
    for k in range(hashes if len(h) else 0):
        low, before = _permuted(h, k), None
        for size in sizes:
            # blocks of a larger size are unions of smaller ones
            low = np.minimum.reduceat(low, begins[size] if before is None else np.searchsorted(before, begins[size]))
            values[size, k], before = low, begins[size]
    return Minima(values, owners)


def candidates(index: Index, minima: Minima) -> set[tuple[int, int]]:
    """(document, item) that share a MinHash value in a block."""
    out: set[tuple[int, int]] = set()
    for size, (values, members) in index.partitions.items():
        for k in range(len(values)):
            low = minima.values.get((size, k))
            if low is None:
                continue
            left, right = np.searchsorted(values[k], low, "left"), np.searchsorted(values[k], low, "right")
            for b in np.flatnonzero(right > left):
                out.update((int(minima.owners[size][b]), int(i)) for i in members[k, left[b] : right[b]])
    return out


def verify(index: Index, item: int, words: list[bytes], h: np.ndarray, ngram: int) -> int:
    """How many distinct shingles of the item the whole document holds, compared word by word."""
    at = np.flatnonzero(np.isin(h, index.hashes[index.starts[item] : index.starts[item + 1]]))
    n = min(ngram, len(words))
    return len(set(shingles_of(index.texts[item].split(b" "), ngram)) & {b" ".join(words[i : i + n]) for i in at})


def search(indexes: Callable[[], Iterable[Index]], sizes: list[int], texts: list[bytes], ngram: int = NGRAM, threshold: float = THRESHOLD, hashes: int = HASHES) -> Iterator[tuple[int, object, int, int]]:
    """(document, item id, shared shingles, item's shingles) at the threshold or above, over all indexes.

    Documents are taken a bounded number of words at a time, and hashed once for all indexes.
    """
    held: list[tuple[int, list[bytes], np.ndarray]] = []
    total = 0

    def found() -> Iterator[tuple[int, object, int, int]]:
        starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])]).astype(np.int64)
        minima = block_minima(np.concatenate([x[2] for x in held]), starts, sizes, hashes)
        for index in indexes():
            for d, item in sorted(candidates(index, minima)):
                doc, words, h = held[d]
                shared, n = verify(index, item, words, h, ngram), int(index.counts[item])
                if shared >= threshold * n - 1e-9:
                    yield doc, index.ids[item], shared, n

    for i, text in enumerate(texts):
        words = words_of(text)
        if words:
            held.append((i, words, shingle_hashes(words, ngram)))
            total += len(words)
        if total >= _SLICE_WORDS:
            yield from found()
            held.clear()
            total = 0
    if held:
        yield from found()


class Indexes:
    """All items as broadcasts of bounded size. Called in a task, they come one after the other; one alone is kept."""

    def __init__(self, context: SparkContext, items: DataFrame, ngram: int, hashes: int):
        """items: distinct (id, text)."""
        self.shared, sizes = [], set()
        for block in item_blocks(items):
            index = build_index(block, ngram, hashes)
            sizes.update(index.partitions)
            if index.ids:
                self.shared.append(context.broadcast(index))
        self.sizes = sorted(sizes)

    def __call__(self) -> Iterator[Index]:
        for shared in self.shared:
            yield shared.value
            if len(self.shared) > 1:
                del shared._value  # read again from its file for the next slice


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct (id, text) rows in blocks of at most ITEMS_AT_ONCE rows and ITEM_BYTES_AT_ONCE bytes, or of one row.

    Blocks follow from a hash; they are counted before one is collected, and there are more of them if one is too large.
    """
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(math.ceil(size["n"] / ITEMS_AT_ONCE), math.ceil(size["b"] / ITEM_BYTES_AT_ONCE))
    while blocks:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("text", F.lit("block")), F.lit(blocks)))
        if blocks == 1:
            break
        sums = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
        if sums.where((F.col("n") > 1) & ((F.col("n") > ITEMS_AT_ONCE) | (F.col("b") > ITEM_BYTES_AT_ONCE))).isEmpty():
            break
        blocks *= 2
    for i in range(blocks):
        yield [(r["id"], r["text"]) for r in dealt.where(F.col("block") == i).orderBy("id", "text").collect()]


def distinct_items(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) for each text, and (id, item) for each item if texts repeat: then id stands for a text, not for an item."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = rows.groupBy("text").agg(F.min("item").alias("id"), F.count("*").alias("n"))
    if texts.where("n > 1").isEmpty():
        return texts.select("id", "text"), None
    numbered = materialise(texts.select("text").withColumn("id", F.monotonically_increasing_id()), "item-texts")
    return numbered.select("id", "text"), materialise(rows.join(numbered, "text").select("id", "item"), "items-of-texts")


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", ngram: int = NGRAM, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that holds at least ``threshold`` of an item.

    containment is the share of the item's distinct word shingles that occur in the document. An item of fewer than
    ngram words is one shingle, and only a document of just these words holds it. Null and empty texts match nothing;
    repeated documents and items keep their rows; null ids stay null. Equal item texts are searched for once and joined
    with their items afterwards; no documents or items give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts, items_of = distinct_items(items, item_id, "text")
    indexes = Indexes(docs.sparkSession.sparkContext, texts, ngram, hashes)
    kind = texts.schema["id"].dataType
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, n_shared long, n_item long, containment double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if indexes.shared else ():
            got = list(search(indexes, indexes.sizes, byte_texts(batch.column(1)), ngram, threshold, hashes))
            if got:
                doc, item, n, size = zip(*got, strict=True)
                n, size = np.array(n), np.array(size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(item, to_arrow_type(kind)), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(n / size)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

    found = rows.mapInArrow(scan, schema)
    if items_of is None:
        return found
    return found.withColumnRenamed("item_id", "id").join(items_of, "id").select("doc_id", F.col("item").alias("item_id"), "n_shared", "n_item", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item to the threshold: one narrow pass over documents.

    Null and empty texts hold nothing and stay; repeated rows go or stay together; null ids, columns of any other name
    and repeated or empty items make no difference. Without items every document stays; an empty table stays empty.
    """
    at = docs.columns.index("text")
    texts = items.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    indexes = Indexes(docs.sparkSession.sparkContext, texts.select(F.lit(0).alias("id"), "text"), ngram, hashes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            if indexes.shared:
                keep[[d for d, *_ in search(indexes, indexes.sizes, byte_texts(batch.column(at)), ngram, threshold, hashes)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
