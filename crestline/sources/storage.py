"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_open = threading.local()
#: scratch paths that were given out and not deleted yet
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder set on the context; a temporary one only under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="crestline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; what is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_sweep)
    _left.add(path)
    return path


def _sweep() -> None:
    jvm = SparkContext._jvm
    for path in sorted(_left) if jvm is not None else ():
        for name in (path, f"{path}-state"):  # a stream keeps its state beside its table
            target = jvm.org.apache.hadoop.fs.Path(name)
            with suppress(Exception):
                target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    _left.clear()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: short lineage that outlives any executor."""
    path = scratch(df.sparkSession, label)
    for made in getattr(_open, "scopes", ()):
        made.paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._crestline_path = path
    return out


class Made:
    """Paths of the tables that were written while a scope was open."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> None:
        self.paths = [p for p in self.paths if p != getattr(df, "_crestline_path", None)]


@contextmanager
def scratch_scope() -> Iterator[Made]:
    """Delete the tables that this thread writes inside, except those that are kept; also if it fails."""
    scopes = _open.__dict__.setdefault("scopes", [])
    made = Made()
    scopes.append(made)
    try:
        yield made
    finally:
        scopes.remove(made)
        spark = SparkSession.getActiveSession()
        for path in made.paths if spark is not None else ():
            _delete(spark, path)


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_crestline_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _left.discard(path)
