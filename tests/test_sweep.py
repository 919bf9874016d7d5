"""The threshold sweep over (token, sentence) pairs against plain Python."""

import random

from siftline.operators import metrics


def test_every_pair_is_swept(spark):
    rnd = random.Random(5)
    units = [(d, u, rnd.randint(0, 1)) for d in range(4) for u in range(5)]
    tokens = [(d, u, rnd.random()) for d, u, _ in units if u for _ in range(rnd.randint(1, 6))]  # unit 0 has no tokens
    pairs = [(t / 40, s / 30) for t in range(40) for s in range(30)]
    keys = "doc_id int, unit_id int"
    got = metrics.sweep(
        spark.createDataFrame(units, f"{keys}, label int"),
        spark.createDataFrame(tokens, f"{keys}, p double"),
        spark.createDataFrame([*pairs, pairs[0]], "token_threshold double, sentence_threshold double"),
        ["doc_id", "unit_id"],
    ).collect()
    assert len(got) == len(pairs) == 1200
    by = {(r.token_threshold, r.sentence_threshold): r for r in got}
    own = {k[:2]: [p for d, u, p in tokens if (d, u) == k[:2]] for k in units}
    for t, s in pairs:
        kept = {k for k, ps in own.items() if ps and sum(p >= t for p in ps) / len(ps) >= s}
        good = {k[:2] for k in units if k[2]}
        tp, fp, fn = len(kept & good), len(kept - good), len(good - kept)
        r = by[t, s]
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
        assert abs(r.keep_rate - len(kept) / len(units)) < 1e-9 and abs(r.precision - tp / max(tp + fp, 1)) < 1e-9 and abs(r.recall - tp / max(tp + fn, 1)) < 1e-9
    assert len({(r.tp, r.fp) for r in got if r.sentence_threshold == 0.5}) > 1


def test_nulls_and_nothing(spark):
    keys = ["k"]
    units = spark.createDataFrame([(1, 1), (2, None), (3, 0), (4, 1)], "k int, label int")
    scored = spark.createDataFrame([(1, 0.9), (1, None), (2, 0.9), (3, 0.5), (9, 1.0)], "k int, p double")
    pairs = spark.createDataFrame([(0.5, 1.0), (0.5, 1.5), (None, 0.5), (0.9, 0.0), (0.9, -1.0)], "token_threshold double, sentence_threshold double")
    got = {(r.token_threshold, r.sentence_threshold): (r.tp, r.fp, r.fn, r.n) for r in metrics.sweep(units, scored, pairs, keys).collect()}
    # a unit of null label counts for n alone; tokens of no unit count for nothing
    assert got == {(0.5, 1.0): (1, 1, 1, 4), (0.5, 1.5): (0, 0, 2, 4), (0.9, 0.0): (1, 1, 1, 4), (0.9, -1.0): (1, 1, 1, 4)}
    assert metrics.sweep(units, scored, pairs.limit(0), keys).count() == 0
    assert metrics.sweep(units.limit(0), scored, pairs, keys).count() == 0
