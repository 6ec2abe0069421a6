"""Spans in texts: one Arrow pass that applies a scanner to whole texts, and the digest columns of a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:long,end:long,base:boolean,text:string>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("text", pa.string())]))


class Span(NamedTuple):
    """A half-open range of code points; base: found by the plain pattern of its kind."""

    kind: str
    start: int
    end: int
    base: bool
    text: str


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed, then end."""
    return sorted(spans, key=lambda x: (x.start, kinds.index(x.kind), x.end))


def scan_texts(docs: DataFrame, scanner: Callable[[], Callable[[str], list[Span]]], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, spans) for every row. scanner() is called once in each task and gives the function of a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for batch in batches:
            found = [[x._asdict() for x in find(text or "")] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and spans with all of them."""
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
