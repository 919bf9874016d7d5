"""Ids that repeat with different texts: the Jaccard join and the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from siftline.llm import ngram_join
from tests.llm.test_duplicates import brute_components, shingle_set


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(8)]
    near = [t.rsplit(" ", 1)[0] + " end" for t in texts]
    # ids 20 and 30 have two texts each: either text has near copies under other ids, 20 joins 10 and 40
    return [(20, texts[0]), (20, texts[1]), (10, near[0]), (40, near[1]), (30, texts[2]), (30, texts[3]), (31, near[3]), (29, near[2]), (5, texts[4]), (5, texts[5]), (6, texts[6]), (6, near[6]), (7, texts[7]), (7, texts[7]), (8, None), (8, ""), (None, texts[0])]


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_each_text_links(df, rows):
    got = ngram_join.ngram_components(df).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r.doc_id is not None} == brute_components(rows)
    assert {r.component_id for r in got if r.doc_id in (10, 20, 40)} == {10}


def test_no_text_goes_without_a_near_copy_that_stays(spark, df, rows):
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    held = [r for r in got if r[0] is not None]
    assert len(held) == len(set(held)) and set(got) <= set(rows) and len(got) - len(held) == 1
    links = lambda a, b: 100 * len(shingle_set(a) & shingle_set(b)) >= 75 * max(1, len(shingle_set(a) | shingle_set(b)))
    for d, t in {r for r in rows if r[0] is not None} - set(held):
        assert any(links(t, u) and e <= d for e, u in held)
    assert not any(links(a[1], b[1]) for i, a in enumerate(held) for b in held[:i])
    assert {d for d, _ in held} == {10, 20, 29, 30, 5, 6, 7, 8}
