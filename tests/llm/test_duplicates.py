"""Fingerprints, suffix dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftline.llm import components, fingerprints, ngram_join, suffix_dedup, suffix_sort


def corpus(seed=4, n=60):
    """Prose with exact and near copies, shared passages, nulls, empties and a repeated id."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = text(60)
    docs = [text(rnd.randint(1, 120)) for _ in range(n)]
    docs += [docs[0], docs[1], docs[1].upper(), passage, text(20) + " " + passage + " " + text(5), passage + "\n" + passage]
    for i in (2, 3, 4, 5):
        near = docs[i].split(" ")
        near[len(near) // 2] = "zzz"
        docs += [" ".join(near), " ".join(near[:-1] + ["q"])]
    rows = list(enumerate(docs)) + [(900, None), (901, ""), (902, " \n"), (903, "a" * 500), (904, "a" * 450), (None, docs[0]), (5, docs[5])]
    return [(d, t, "x", i) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, anchor string, id int").repartition(4)


def removed(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = True
        runs = int((mark & ~np.concatenate(([False], mark[:-1]))).sum()) if len(b) else 0
        out.append((len(b), int(mark.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mark].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(df, rows):
    got = suffix_dedup.repeat_digests(df).collect()
    want = [(d, *x) for (d, *_), x in zip(rows, removed([r[1] for r in rows]), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_suffix_dedup_rewrites_texts_and_keeps_columns(df, rows):
    got = suffix_dedup.remove_repeats(df).select(*df.columns).collect()
    assert len(got) == len(rows) and {r.id for r in got} == {r[3] for r in rows}
    gone = removed([r[1] for r in rows])
    for r in got:
        if gone[r.id][1] == 0:
            assert r.text == rows[r.id][1]
    assert suffix_dedup.repeat_digests(df.limit(0)).count() == 0


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    whole = [(0, text + text[1000:2000])]
    import pyarrow as pa

    found = [x for _, base, begins, ends, data in ((i, b, s, e, d) for d, i, b, s, e in suffix_dedup.stretches(pa.array([whole[0][1]]), 200)) for x in [(int(base[0]), len(data))]]
    assert len(found) > 5 and found[-1][0] + found[-1][1] == 7000


def test_orders_suffixes_deep_and_shallow():
    rnd = random.Random(2)
    data = np.frombuffer("".join(rnd.choice("ab") for _ in range(400)).encode() * 3, np.uint8)
    starts = np.arange(len(data) - 60)
    order, segment = suffix_sort.multikey(suffix_sort.Text(data, 60), starts, np.zeros(len(starts), np.int64), 16)
    raw = data.tobytes()
    heads = [raw[s : s + 16] for s in order.tolist()]
    assert heads == sorted(heads)
    assert all((segment[i] == segment[i + 1]) == (heads[i] == heads[i + 1]) for i in range(len(heads) - 1))
    keys = [int.from_bytes(raw[s : s + 60], "big") for s in range(300)] + [5, 5]
    ranked, same = suffix_sort.blind_trie(keys)
    assert [keys[i] for i in ranked] == sorted(keys) and sum(same) >= 1
    seen = Counter(raw[s : s + 60] for s in starts)
    assert suffix_sort.repeated(data, starts, np.zeros(len(starts), np.int64), 60, 16).tolist() == [seen[raw[s : s + 60]] > 1 for s in starts]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t, *_ in rows if d is not None]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                both = len(x & y)
                if both and 100 * both >= 75 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(d, len(s), label[d]) for d, s in sets}


@pytest.mark.parametrize("tile", [2048, 3])
def test_ngram_join_equals_brute_force(df, rows, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    got = ngram_join.ngram_components(df).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r.doc_id is not None} == brute_components(rows)


def test_bitmaps_bound_the_overlap_and_fold():
    rnd = np.random.default_rng(0)
    for n in (5, 600, 3000):
        x, y = (np.unique(rnd.integers(0, n * 2, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        raw = [ngram_join.bitmaps(np.zeros(len(s), np.int64), s, 1)[0] for s in (x, y)]
        for width in (1024, min(8 * len(r) for r in raw)):
            a, b = (ngram_join.stacked([r], width)[0] for r in raw)
            differ = int(np.bitwise_count(a ^ b).sum())
            assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) // 2


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_fingerprints_equal_brute_force(spark, rows):
    some = [r for r in rows if r[0] is not None and r[3] < len(rows) - 1]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(some, "doc_id long, text string, anchor string, id int")).collect()}
    ordered = sorted(some, key=lambda r: -r[0])
    assert len(got) == len(ordered)
    for i, (d, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.common_next == next((k for k, (a, b) in enumerate(zip(t, after, strict=False)) if a != b), min(len(t), len(after)))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == fingerprints.Prefixes(after).fingerprint()) == (t == after)


def test_span_hashes_and_extensions():
    a, b = fingerprints.Prefixes("xxabcabc"), fingerprints.Prefixes("abcabd")
    assert a.span(2, 5) == a.span(5, 8) == b.span(0, 3) != b.span(3, 6)
    assert a.common_extension(2, b, 0) == 5
    same = "wort " * 200
    assert fingerprints.likeness(fingerprints.Prefixes(same).fingerprint(), fingerprints.Prefixes(same).fingerprint()) == 1
    assert fingerprints.likeness(fingerprints.Prefixes("").fingerprint(), fingerprints.Prefixes("a").fingerprint()) == 0


def test_lone_and_no_row(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprint_edits(one.limit(0)).count() == 0
