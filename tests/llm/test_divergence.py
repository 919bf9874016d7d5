"""The audit of sources against plain Python with fractions of whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from siftline.llm import divergence


def brute(rows, least_docs=30, smoothing=5, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, source, text in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ws in found:
        docs[lang].update(set(ws))
        counts[lang, source].update(ws)
    out = []
    for lang in docs:
        kept = [t for t, d in docs[lang].items() if d >= least_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + smoothing) // (n + smoothing * len(kept)) for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum((Counter(c) for c in groups.values()), Counter()))
        for s in groups:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            term = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


def corpus(n, sources, seed=1):
    r = random.Random(seed)
    words = ["The", "of", "Été", "straße", "ÄRGER", "日本", "x", "K", "don't", "a1b2"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for k in range(n):
        lang = r.choice(["en", "en", "de", None, "zz"])
        source = r.choice(["hot", *(f"s{i}" for i in range(sources)), None])
        text = " ".join(words[min(int(r.expovariate(0.03)), len(words) - 1)] for _ in range(r.choice([0, 1, 5, 60, 400])))
        rows.append((lang, source, {0: None, 1: "", 2: "123 !?\x00"}.get(k % 40, text)))
    rows += [("few", "a", "only once"), ("few", "b", "and once"), ("en", "empty", ""), ("en", "numbers", "1 2 3"), ("one", "alone", "alone " * 50)]
    return rows + rows[:20]  # some rows repeat


@pytest.mark.parametrize("options", [{}, {"least_docs": 5, "smoothing": 1, "top": 3, "sizes": divergence.Sizes(3, 7, 2, 50)}])
def test_equals_brute_force(spark, options):
    rows = corpus(600, 7)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, block string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df, **options).collect())
    options.pop("sizes", None)
    assert got == brute(rows, **options)


def test_shares_are_exact_beyond_64_bits(spark):
    import numpy as np

    counts = np.array([[0, 7, 10**12, 4 * 10**15]], np.int64)
    below = np.array([[5 * 10**15 + 3]], np.int64)
    want = [1 + 10**9 * (int(c) + 5) // (5 * 10**15 + 3) for c in counts[0]]
    assert divergence.shares(counts, below, 5)[0].tolist() == want
    sql = divergence.share_sql("c", "5000000000000003 - 50", "10L", 5)
    got = [r.p for r in spark.createDataFrame([(int(c),) for c in counts[0]], "c long").selectExpr(f"{sql} AS p").collect()]
    assert got == want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_long_term_and_text(spark):
    rows = [("en", "a", "z" * 2_000_000)] * 3 + [("en", "b", "word " * 100_000)] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(df, least_docs=2).collect()) == brute(rows, least_docs=2)
