"""What the operators share: byte-level tokenisers, table paths and local union-find."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crestline.sources.storage import discard, materialise, scratch_scope, shared_dir

__all__ = ["ALNUM", "LOWER", "byte_texts", "discard", "env_path", "local_roots", "materialise", "read", "scratch_scope", "shared_dir", "table_path"]

#: lower-cases A-Z, leaves every other byte
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space; bytes of other characters stay
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b, vectorised."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
