import random

import pytest

from crestline.operators.dedup import drop_repeats, mark_repeats
from crestline.streaming.dedup import drop_repeats_stream

ROT, R = 10_000_000, 3


def frame(spark, rows):
    """rows: (identity, query, seconds)."""
    return spark.createDataFrame([(i, q, round(t * 1e6), f"{n:06d}") for n, (i, q, t) in enumerate(rows)], "identity string, query string, ts_us long, event_id string")


def repeats(spark, rows):
    return [r.repeat for r in mark_repeats(frame(spark, rows), ROT, R).orderBy("event_id").collect()]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("u:u1", "iphone", 0)], [False]),
        ([("u:u1", "iphone", 0), ("u:u1", "iphone", 1)], [False, True]),
        ([("u:u1", "iphone", 0), ("u:u1", "iphone", 1), ("u:u2", "iphone", 2)], [False, True, False]),
        ([("u:u1", "iphone", 0), ("u:u1", "samsung", 1)], [False, False]),
        ([("s:s1", "iphone", 0), ("s:s1", "iphone", 1), ("s:s2", "iphone", 2)], [False, True, False]),
        ([("u:abc", "iphone", 0), ("s:abc", "iphone", 1)], [False, False]),
        ([("u:u1", "iphone", 5), ("u:u1", "iphone", 35)], [False, False]),
        ([("u:u1", "iphone", 5), ("u:u1", "iphone", 15), ("u:u1", "iphone", 35)], [False, True, True]),  # a repeat refreshes
        ([("u:a|b", "c", 0), ("u:a", "b|c", 1)], [False, False]),
    ],
)
def test_sequences(spark, rows, expected):
    assert repeats(spark, rows) == expected


def model(rows, rotations):
    """Rotating sets: a key is a repeat if any of the last sets holds it; it is always put into the present one."""
    out, sets, now = [], [set() for _ in range(rotations)], None
    for identity, query, t in rows:
        epoch = int(t // 10)
        while now is not None and now < epoch:
            sets = [set(), *sets[:-1]]
            now += 1
        now = epoch if now is None else now
        out.append(any((identity, query) in s for s in sets))
        sets[0].add((identity, query))
    return out


@pytest.mark.parametrize("rotations", [2, 3, 4])
def test_against_rotating_sets(spark, rotations):
    rng = random.Random(rotations)
    rows = sorted([(f"u:{rng.randrange(6)}", f"q{rng.randrange(4)}", rng.randrange(0, 2000) / 2 + i * 1e-3) for i in range(1500)], key=lambda x: x[2])
    df = frame(spark, rows)
    assert [r.repeat for r in mark_repeats(df, ROT, rotations).orderBy("event_id").collect()] == model(rows, rotations)
    kept = {r.event_id for r in drop_repeats(df, ROT, rotations).collect()}
    assert kept == {f"{i:06d}" for i, x in enumerate(model(rows, rotations)) if not x}


def test_all_distinct_and_empty(spark):
    rows = [(f"u:{u}", f"q{q}", 0) for u in range(10) for q in range(100)]
    assert drop_repeats(frame(spark, rows), ROT, R).count() == 1000
    assert drop_repeats(frame(spark, rows).limit(0), ROT, R).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted([(f"u:{rng.randrange(5)}", f"q{rng.randrange(3)}", rng.randrange(1000, 1600)) for _ in range(400)], key=lambda x: x[2])
    df = frame(spark, rows).selectExpr("*", "timestamp_micros(ts_us) as timestamp")
    def run(files):  # each file is a micro-batch; state and offsets outlive the query
        for k in files:
            df.where(f"event_id >= '{k * 100:06d}' and event_id < '{k * 100 + 100:06d}'").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        out = drop_repeats_stream(stream, ROT, R, "10 minutes")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run([0, 1])
    run([2, 3])
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.event_id for r in drop_repeats(df, ROT, R).collect()}
