"""The pipeline stage by stage against plain Python, each on its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siftline.llm import quality
from tests.llm.test_duplicates import brute_components


@pytest.fixture(scope="module")
def steps(spark):
    """The input and output rows of every stage over the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rnd = random.Random(2)
    noise = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(150))
    digits = " ".join("".join(rnd.choices("0123456789abcdef", k=32)) for _ in range(60))
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "1 2 3", "en", None, 5), (9004, noise, None, "s", 0), (9005, digits, None, "s", 0)], docs.schema)
    docs, out = docs.union(extra).repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return out


def test_stages_keep_the_columns(steps):
    assert [s[0] for s in steps] == ["language_id", "quality_rules", "ngram_join", "suffix_dedup", "packing"]
    for _, _, after, columns in steps[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"] and after


def test_language_rejects_texts_without_letters_and_noise(steps):
    _, before, after, _ = steps[0]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {9001, 9002, 9003, 9004, 9005} <= gone
    assert all(r.doc_id in (9004, 9005) or not re.search(r"[^\W\d_]", r.text or "") for r in before if r.doc_id in gone)


def test_quality_rejects_what_the_base_rules_reject(steps):
    _, before, after, _ = steps[1]
    kept = {r.doc_id for r in after}
    for r in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(tri)
        covered = {j for i, t in enumerate(tri) if seen[t] > 1 for j in (i, i + 1, i + 2)}
        if len(words) < quality.WORDS or 100 * len(covered) > quality.REPEATED * len(words):
            assert r.doc_id not in kept


def test_one_document_of_each_group_stays(steps):
    _, before, after, _ = steps[2]
    want = {d for d, _, top in brute_components([(r.doc_id, r.text) for r in before]) if d == top}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_repeats_are_removed(steps):
    _, before, after, _ = steps[3]
    raws = [(r.text or "").encode() for r in before]
    seen = Counter(b[i : i + 200] for b in raws for i in range(len(b) - 199))
    want = Counter()
    for r, raw in zip(before, raws, strict=True):
        mark = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        # what is left of a character that a cut falls into goes too
        want[r.doc_id, bytes(c for c, m in zip(raw, mark, strict=True) if not m).decode(errors="ignore")] += 1
    assert Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_packing_takes_all_documents(steps):
    _, before, after, _ = steps[4]
    by = {}
    for r in after:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(by) == {r.doc_id for r in before}
    for pieces in by.values():
        assert sum(p[1] for p in pieces) == pieces[0][2]
