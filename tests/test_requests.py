"""Streams of requests: full batches, waiting times, restarts, and counters."""

import time

import pytest
from pyspark.sql import functions as F

from siftline.streaming import requests


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, requests.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def put(spark, folder, first, n):
    spark.range(first, first + n).selectExpr("id", "id % 2 AS lane", "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('r', id) END AS text").coalesce(1).write.mode("append").parquet(folder)


def rows(df):
    return sorted((r.lane, r.batch, r.place, r.id, r.text, r.ended) for r in df.collect())


def test_batches_fill_across_a_restart_and_wait(rocksdb, tmp_path):
    spark, folder, out, checkpoint = rocksdb, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    read = lambda: spark.readStream.schema("id long, lane long, text string").parquet(folder)
    batches = lambda wait: requests.micro_batches(read(), "lane", most=4, wait_ms=wait)
    put(spark, folder, 0, 11)  # six and five rows: one full batch of each lane, two rows and one row wait
    got = rows(requests.run_until(batches(3_600_000), out, checkpoint, 8, seconds=60))
    assert [(x[0], x[1], x[2], x[5]) for x in got] == [(lane, 0, k, "full") for lane in (0, 1) for k in range(4)]
    put(spark, folder, 11, 6)  # started again: those that wait come first
    got = rows(requests.run_until(batches(3_600_000), out, checkpoint, 16, seconds=60))
    assert [x[:3] for x in got] == [(lane, b, k) for lane in (0, 1) for b in (0, 1) for k in range(4)]
    assert {x[3] for x in got if x[:2] == (1, 1)} >= {9}
    time.sleep(0.1)
    put(spark, folder, 17, 3)  # of 10 rows in each lane two wait, with the first one's old time: another checkpoint shows the short one
    more = str(tmp_path / "more")
    got = rows(requests.run_until(batches(50), more, str(tmp_path / "c2"), 20, seconds=120))
    assert sorted(x[3] for x in got) == list(range(20)) and all((x[4] is None) == (x[3] % 5 == 0) for x in got)
    sizes = {}
    for x in got:
        sizes.setdefault(x[:2], []).append((x[2], x[5]))
    for places in sizes.values():
        assert [k for k, _ in places] == list(range(len(places))) and len(places) <= 4
        assert {e for _, e in places} == ({"full"} if len(places) == 4 else {"waited"})
    assert any(len(p) < 4 for p in sizes.values())


def test_a_killed_run_writes_each_row_once(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k in range(4):
        put(spark, folder, 10 * k, 10)
    stream = spark.readStream.schema("id long, lane long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    taken = []

    def work(batch):
        n = batch.count()
        taken.append(n)
        if len(taken) == 3:
            batch.write.mode("append").parquet(f"{out}/batch=2")  # half way, then gone
            raise RuntimeError("killed")
        return batch.select("id")

    with pytest.raises(Exception, match="killed"):
        requests.drained(stream, work, out, checkpoint)
    requests.drained(stream, work, out, checkpoint)
    requests.drained(stream, work, out, checkpoint)  # nothing is left
    assert taken == [10] * 5, "one file at a time, and the third one twice"
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == list(range(40))


def test_counters_equal_a_batch_count(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        put(spark, folder, 7 * k, 7)
    stream = spark.readStream.schema("id long, lane long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    seen = requests.observed(stream, "seen", n=F.count(F.lit(1)), none=F.count_if(F.col("text").isNull()), total=F.sum("id"))
    with requests.Counters(spark, "seen") as c:
        requests.drained(seen, lambda b: b.select("id"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert len(c.batches) == 3
    assert c.totals == {"n": 21, "none": 5, "total": sum(range(21))}
