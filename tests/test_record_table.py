"""The bucketed record table against the batch operator, with replays and broken batches."""

import os
import random

import pytest

from patchtrace.operators import spans
from patchtrace.streaming.record_table import RecordTable, upsert_arrivals

SCHEMA = "file_path string, seq long, lang string, n int"


def _rows(seed, n=200, keys=25):
    rng = random.Random(seed)
    return [(rng.choice([f"k{rng.randrange(keys)}", "hot", None]), rng.randrange(40), rng.choice(["a", "b", None]), rng.randrange(5))
            for _ in range(n)]


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shuffled_repeated_and_late_batches(spark, tmpdir_path):
    rows = _rows(1)
    want = _sorted(spans.latest_per_key(spark.createDataFrame(rows, SCHEMA)))
    batches = [rows[i:i + 50] for i in range(0, 200, 50)]
    for turn, order in enumerate([[0, 1, 2, 3], [3, 2, 2, 0, 1, 0]]):
        table = RecordTable(spark, f"{tmpdir_path}/{turn}", SCHEMA, n_buckets=7)
        for i, b in enumerate(order):  # the same rows may come again as another batch
            table.upsert(spark.createDataFrame(batches[b], SCHEMA), i)
        assert _sorted(table.read()) == want


def test_a_batch_rewrites_its_buckets_only_and_once(spark, tmpdir_path, monkeypatch):
    table = RecordTable(spark, f"{tmpdir_path}/t", SCHEMA, n_buckets=8)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame(_rows(2), SCHEMA), 0)
    before = _sorted(table.read())
    one = spark.createDataFrame([("k1", 99, "z", 1)], SCHEMA)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(RecordTable, "_commit", stop)
        with pytest.raises(RuntimeError):
            table.upsert(one, 1)
    assert _sorted(table.read()) == before  # written, not committed
    again = RecordTable(spark, f"{tmpdir_path}/t", SCHEMA, n_buckets=8)
    again.upsert(one, 1)
    again.upsert(spark.createDataFrame([("k1", 100, "never", 1)], SCHEMA), 1)  # a replay of batch 1
    log = again.log()
    assert [len(r["buckets"]) for r in log][1:] == [1] and len(log[0]["buckets"]) > 4
    assert len(os.listdir(again._folder(1))) <= 3  # one bucket, _SUCCESS and its checksum
    want = [r for r in before if r[0] != "k1"] + [("k1", 99, "z", 1)]
    assert _sorted(again.read()) == sorted(want, key=str)
    again.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert _sorted(again.read()) == sorted(want, key=str) and len(again.log()) == 3


def test_stream_with_restart(spark, tmpdir_path):
    rows = _rows(3)
    landing, state = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "state")
    for turn in range(2):
        table = RecordTable(spark, f"{tmpdir_path}/t", SCHEMA, n_buckets=5)
        spark.createDataFrame(rows[turn::2] + rows[:20], SCHEMA).repartition(2).write.mode("append").parquet(landing)
        upsert_arrivals(spark, landing, SCHEMA, state, table, max_files_per_trigger=1)
    assert len(table.log()) == 4
    assert _sorted(table.read()) == _sorted(spans.latest_per_key(spark.createDataFrame(rows, SCHEMA)))
