"""Lists of many tiles: clusters of near copies and passages of many documents, against brute force."""

import random

import numpy as np
import pytest

from siftline.llm import ngram_join
from tests.llm.test_duplicates import brute_components


def clusters(seed):
    """Near copies around one text at all distances, some only linked through others; texts that share a half."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            t[rnd.randrange(60)] = rnd.choice(words)
        rows.append((1000 - 7 * i, " ".join(t)))
    for i in range(70):  # half in common: under the same shingles, but no links
        rows.append((2000 + i, " ".join(base[:40] + [rnd.choice(words) for _ in range(rnd.randint(2, 40))])))
    chain = [rnd.choice(words) for _ in range(80)]
    for i in range(40):
        rows.append((3000 - i, " ".join(chain[i // 2 : 60 + i // 2])))
    rows += [(5000 + i, " ".join(base)) for i in range(30)] + [(6000, None), (6001, "")]
    return rows


@pytest.mark.parametrize("tile, seed", [(4, 1), (16, 2), (4096, 3)])
def test_all_links_are_found(spark, monkeypatch, tile, seed):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = clusters(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {tuple(r) for r in ngram_join.ngram_components(df).collect()} == brute_components(rows)


def test_tiles_are_made_and_pairs_across_them_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    df = spark.createDataFrame(clusters(1), "doc_id long, text string").coalesce(1)
    posted = ngram_join.postings(df, np.stack([np.arange(1 << ngram_join.SKETCH), np.full(1 << ngram_join.SKETCH, 64)]), "doc_id", "text")
    assert posted.agg({"tiles": "max"}).first()[0] == 16
    lists = ngram_join.lists_of(posted).collect()
    assert len({(r.shingle, r.tile) for r in lists}) == len(lists) and max(r.tile for r in lists) > 3


def test_a_tile_of_thousands_of_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 1)
    posted = spark.range(4200).selectExpr("7L AS shingle", "0 AS tile", "1 AS tiles", "id", "CAST(100 AS BIGINT) AS n").repartition(2)
    lists = ngram_join.lists_of(posted).collect()
    assert sorted(i for r in lists for i in r.ids) == list(range(4200))
    assert len({r.tile for r in lists}) == len(lists) == 2100 and max(r.tile for r in lists) == 2099 << 20


def test_links_within_connect_what_passes():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 1 << 62, 300).astype(np.uint64))]
    for _ in range(299):
        near = sets[rnd.integers(len(sets))].copy()
        near[rnd.integers(0, len(near), 30)] = rnd.integers(0, 1 << 62, 30).astype(np.uint64)
        sets.append(np.unique(near))
    sets.sort(key=len)
    n = np.array(list(map(len, sets)))
    raw = ngram_join.bitmaps(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), len(sets))
    ids = rnd.permutation(len(sets))
    every = np.arange(len(sets))
    passing = {(i, j) for p in ngram_join.tile_pairs(n, raw, every, every) for i, j in zip(*p, strict=True)}
    linking = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert linking <= passing
    a, b = ngram_join.links_within(ids, n, raw)
    assert set(zip(a, b, strict=True)) <= passing
    label = rnd.integers(0, 5, len(sets))
    a, b = ngram_join.links_across(n, raw, label, np.zeros(len(sets), bool))
    found = {frozenset(p) for p in zip(a, b, strict=True)}
    assert found == {frozenset(p) for p in passing if label[p[0]] != label[p[1]]}
