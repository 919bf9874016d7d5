"""Exact batches against sequential Python, however rows are dealt out."""

import hashlib
import random

import pytest

from siftline.operators import windows
from siftline.operators.numbering import numbered


def filled(rows, capacity):
    out, batch, held = {}, -1, 0
    for key, n in sorted(rows, key=lambda r: (r[1] or 0, r[0])):
        if batch < 0 or (held and (n or 0) * (held + 1) > capacity):
            batch, held = batch + 1, 0
        held += 1
        out[key] = batch
    return out


def sampled(rows, batch_size, bucket_size, replicas, max_tokens, drop_last, shuffle):
    mixed = lambda *x: hashlib.sha1("\0".join(["42", "0", *map(str, x)]).encode()).hexdigest()
    order = sorted(rows, key=lambda r: (mixed(r[0]), r[0])) if shuffle else sorted(rows)
    batches = []
    for m in range(0, len(order), bucket_size * batch_size):
        chunk, own = sorted(order[m : m + bucket_size * batch_size], key=lambda r: r[1] or 0), []
        for key, n in chunk:
            if not own or len(own[-1]) == batch_size or (max_tokens and (len(own[-1]) + 1) * (n or 0) > max_tokens):
                own.append([])
            own[-1].append(key)
        batches += [((mixed(m // (bucket_size * batch_size), j) if shuffle else ""), m, j, b) for j, b in enumerate(own) if len(b) == batch_size or not drop_last]
    batches = [b for *_, b in sorted(batches)]
    batches = batches[: len(batches) // replicas * replicas]
    return {key: (i, i % replicas, i // replicas) for i, b in enumerate(batches) for key in b}


def lengths(seed, n):
    r = random.Random(seed)
    return [(k, r.choice([None, 0, 1, 1, 2, 3, 5, 7, 7, 7, 40, r.randint(1, 200), 1000])) for k in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("capacity", [1, 7, 64, 100_000])
def test_fill(spark, capacity):
    rows = lengths(capacity, 400)
    for parts in (1, 7):
        df = spark.createDataFrame([(*r, "x") for r in rows], "key int, n int, first string").repartition(parts)
        got = windows.fill_batches(df, "n", capacity, "key")
        assert got.columns == ["key", "n", "first", "batch"]
        assert {r.key: r.batch for r in got.collect()} == filled(rows, capacity)
    assert windows.fill_batches(df.limit(0), "n", capacity, "key").collect() == []


@pytest.mark.parametrize("options", [dict(), dict(max_tokens=100, replicas=3), dict(drop_last=True, replicas=2), dict(max_tokens=30, drop_last=True), dict(shuffle=False, replicas=4)])
def test_sampler(spark, options):
    rows = lengths(5, 333)
    df = spark.createDataFrame(rows, "key int, n int").repartition(5)
    got = windows.sampler_batches(df, "n", "key", batch_size=6, bucket_size=5, **options)
    want = sampled(rows, 6, 5, options.get("replicas", 1), options.get("max_tokens"), options.get("drop_last", False), options.get("shuffle", True))
    assert {r.key: (r.batch, r.replica, r.step) for r in got.collect()} == want


def test_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randint(0, 50), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, "s string, k int, __at string").repartition(6)
    got = numbered(df, ["s", "k"]).orderBy("number").collect()
    assert [(x.s, x.k) for x in got] == sorted((s, k) for s, k, _ in rows)
    assert [x.number for x in got] == list(range(500))
    assert numbered(df.limit(0), ["k"]).collect() == []


def test_no_task_sees_all_rows(spark):
    df = spark.createDataFrame([(k, k % 9) for k in range(200)], "key int, n int").repartition(4)
    for out in (windows.fill_batches(df, "n", 50, "key"), windows.sampler_batches(df, "n", "key", batch_size=4, bucket_size=3)):
        plan = out._jdf.queryExecution().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
