"""Columns with the names that operators use inside, nulls, repeats and empty tables."""

import random
from collections import Counter

import pytest

from siftline.llm import quality, suffix_dedup
from tests.llm.test_duplicates import corpus, removed


@pytest.mark.parametrize("split", [1000, 0])
def test_suffix_dedup_with_clashing_names_and_null_ids(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    word = lambda n: "".join(rnd.choice("xyz ") for _ in range(n))
    rows = [r[1] for r in corpus(9, 20)]
    # one line in many surroundings, some of which return
    around = [(word(150), word(150)) for _ in range(6)]
    rows += [a + line + b for a, _ in around for _, b in around] + [word(90) + line + around[0][1][:140], around[1][0][-140:] + line + word(60)]
    rows += [rows[3], rows[3], "é" * 200, "é" * 230, None, "", None]
    names = ("__id", "__k", "__spans", "__asked", "__row", "__mark", "anchor", "part")
    df = spark.createDataFrame([(None if i % 3 else 7, t, *(i + k for k in range(len(names)))) for i, t in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    kept = suffix_dedup.remove_repeats(df)
    assert sorted(kept.columns) == sorted(df.columns)
    got = {r["__id"]: r for r in kept.collect()}
    assert all(r["part"] == i + len(names) - 1 for i, r in got.items()) and len(got) == len(rows)
    digests = Counter(tuple(r)[1:] for r in suffix_dedup.repeat_digests(df).collect())
    assert digests == Counter(removed(rows))


def test_suffix_dedup_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeat_digests(df).collect() == []


def test_quality_keeps_other_columns(spark):
    names = ["_text", "_words", "_hashes", "_lines", "_grams", "_q_text", "__q_hashes", "_ratios"]
    rows = [(1, "a b c " * 30), (2, None), (3, ""), (None, "so many other words " + " ".join(f"w{i}" for i in range(60))), (1, "a b c " * 30)]
    df = spark.createDataFrame([(d, t, *(["kept as it is"] * len(names))) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(df, labels)
    assert out.columns[: len(df.columns)] == df.columns and not [c for c in out.columns if "q_" in c and c not in df.columns]
    got = out.collect()
    assert len(got) == len(rows) and all(r[n] == "kept as it is" for r in got for n in names)
    assert {r.n_repeat_words for r in got if r.doc_id == 1} == {90} and [r.base_failed for r in got if r.text in (None, "")] == [True, True]
    empty = quality.judge(df.limit(0), labels.limit(0))
    assert empty.collect() == [] and empty.columns == out.columns
    assert set(quality.base_rules(df).columns) == {*df.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}


def test_repeated_windows_by_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefghijklmnop"[: rnd.randint(2, 16)]) for _ in range(rnd.randint(0, 70))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in quality.base_rules(df).collect():
        w = r.text.split()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        want = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert r.n_repeat_words == len(want)
