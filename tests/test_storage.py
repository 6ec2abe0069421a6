import os
import subprocess
import sys

import pytest

from crestline.sources.storage import discard, materialise, scratch_scope, shared_dir


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_scopes(spark):
    before = folders(spark)
    with scratch_scope() as outer:
        kept = materialise(spark.range(3), "kept")
        with scratch_scope():
            materialise(spark.range(4), "inner")
        assert len(folders(spark) - before) == 1
        materialise(spark.range(5), "gone")
        outer.keep(kept)
    assert kept.count() == 3 and len(folders(spark) - before) == 1
    discard(kept)
    assert folders(spark) == before
    with pytest.raises(KeyError), scratch_scope():
        materialise(spark.range(1), "failed")
        raise KeyError
    assert folders(spark) == before


def test_what_is_left_goes_with_the_driver(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from crestline.sources.storage import materialise
assert materialise(spark.range(3), "table").count() == 3
import os; assert any(x.startswith("table-") for x in os.listdir("{tmp_path}/shared"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert not [x for x in os.listdir(tmp_path / "shared") if x.startswith("table-")]
