"""Highlight labels and the agreement report: against brute force, against SQL, and by their rules."""

import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import sentences
from siftline.operators.align import align_rows
from siftline.plans import catalog, catalog_labels, evaluation, highlights
from tests.test_align import fragments, one, plain, shingles, tokens, units
from tests.test_catalog import DATA, db, rows  # noqa: F401


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", ["label_highlights", "agreement_report"])
def test_equals_sql(spark, db, name):  # noqa: F811
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_align_rows_equals_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["é", "Straße", "ﬁn"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    cases = []
    for k in range(120):
        us = [text(r.randint(0, 14)) for _ in range(r.randint(0, 9))] + ["!!", ""] * (k % 2)
        fs = [text(r.randint(0, 9)) for _ in range(2)] + [" ".join(us[i : i + 2]) for i in range(0, len(us), 3)] + [u[2:40] for u in us[:2]]
        cases.append((k % 50, fs, us))
    cases += [(1, None, ["a b c d e f g"]), (1, ["a b c d e f g"], None), (1, [], []), (1, ["a b c d e f"], ["x" + "a b c d e f" + "y", "a b c d e f"])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "at int, key int, f array<string>, u array<string>")
    got = {x.at: (x.unit_ids, x.n_fragments, x.n_matched) for x in align_rows(df, "f", "u").collect()}
    for i, (_, fs, us) in enumerate(cases):
        fs, us = fs or [], us or []
        assert got[i] == one(fs, [shingles(tokens(u)) for u in us], [plain(u) for u in us]), i
    assert sum(len(v[0]) for v in got.values()) > 100 and set(align_rows(df, "f", "u").columns) == {*df.columns, "unit_ids", "n_fragments", "n_matched"}


def test_align_rows_shuffles_nothing(spark):
    df = spark.range(3).select(F.array(F.lit("a")).alias("f"), F.array(F.lit("a")).alias("u"))
    assert "Exchange" not in align_rows(df, "f", "u")._jdf.queryExecution().toString()


QUERIES = "query_id string, query string, topic string, intent string, ord int"
RESULTS = "query_id int, url string, title string, published_date string, text string, highlights array<string>, highlight_scores array<double>, score double"


def test_highlight_rows(spark):
    first, second = "Consumer groups let several consumers share partitions.", "A rebalance is triggered whenever a consumer leaves."
    body = f"{first} {second}"
    queries = spark.createDataFrame([("1", "q1", "t", "i", 1), ("2", "q2", None, None, 2), ("3", "q3", None, None, 3)], QUERIES)
    results = spark.createDataFrame([
        (1, "a", "T", "d", body, [f"{second} [...] tiny", first], [0.9, 0.1], 0.5),
        (1, "a", "T", "d", body, [f"{second} [...] tiny", first], [0.9, 0.1], 0.5),  # repeated: a row of its own
        (1, "b", None, None, body, [first, second], [0.1, 0.9], None),  # the first falls below the least
        (1, "c", None, None, body, [first], None, None),  # no scores: nothing is filtered
        (1, "d", None, None, body, None, None, None),
        (1, "e", None, None, body, ["nothing of this kind stands anywhere in the text"], [], None),
        (1, "f", None, None, "One. " * 4, [first], [1.0], None),
        (1, "g", None, None, "", [first], [1.0], None), (1, "h", None, None, None, [first], [1.0], None), (1, "i", None, None, " \n", [first], [1.0], None),
        (2, "a", None, None, body, [first], [1.0], None), (3, "a", None, None, body, [first], [1.0], None), (9, "a", None, None, body, [first], [1.0], None),
    ], RESULTS)
    done = spark.createDataFrame([("2", "z")], "query_id string, doc_id string")
    out = highlights.label_highlights(queries, results, done=done, limit=1, least=0.5, most=3, cut=sentences)
    assert out.columns[:7] == ["query_id", "doc_id", "origin", "labeler_provider", "labeler_model", "prompt_version", "status"]
    got = sorted(((r.doc_id, r.status, r.relevant_unit_ids, r.n_units, r.n_kept, r.n_fragments, r.n_fragments_matched, r.n_fragments_dropped) for r in out.collect()))
    assert got == [
        ("a", "ok", [1], 2, 1, 1, 1, 0), ("a", "ok", [1], 2, 1, 1, 1, 0), ("b", "ok", [1], 2, 1, 1, 1, 0), ("c", "ok", [0], 2, 1, 1, 1, 0),
        ("d", "skipped:empty_align", [], 2, 0, 0, 0, 0), ("e", "skipped:empty_align", [], 2, 0, 1, 0, 1), ("f", "skipped:long(4)", [], 0, 0, 0, 0, 0),
    ]
    assert {r.query for r in out.collect()} == {"q1"}
    assert highlights.highlight_counts(out).first().asDict() == {"written": 7, "kept": 4, "skipped_long": 1, "skipped_empty": 2}
    everyone = highlights.label_highlights(queries, results, cut=sentences)
    assert {r.query_id for r in everyone.collect()} == {"1", "2", "3"}
    assert highlights.label_highlights(queries, results.limit(0), cut=sentences).collect() == []


LABELED = "query_id string, doc_id string, relevant_unit_ids array<int>, status string, tokens_in int, tokens_out int, labeler_model string, ord int"
PRICES = "model string, price_in double, price_out double"


def test_agreement(spark):
    gold = [("1", "a", [0, 1], "ok", 10, 1, "m", 1), ("1", "b", None, "ok", 10, 1, "m", 2), ("1", "c", [3], "ok", 10, 1, "other", 3), ("1", "d", [1], "error", 99, 9, "m", 4), ("1", "e", [], "ok", 10, 1, "m", 5), ("1", "f", [7], "ok", 10, 1, "m", 6), ("1", "f", [2, 2, 4], "ok", 20, 2, "m", 7)]
    pred = [("1", "a", [1, 0], "ok", 5, 1, "cheap", 1), ("1", "b", [], "ok", 5, 1, "cheap", 2), ("1", "c", [], "ok", 5, 1, "m", 3), ("1", "d", [1], "ok", 5, 1, "m", 4), ("1", "e", [1], "ok", None, 1, "m", 5), ("1", "f", [4, 5], "ok", 5, 1, "m", 6)]
    prices = spark.createDataFrame([("m", 2.0, 10.0), ("other", 100.0, 100.0)], PRICES)
    g, p = spark.createDataFrame(gold, LABELED), spark.createDataFrame(pred, LABELED)
    r = evaluation.agreement_report(g, p, prices).first()
    assert (r.n_shared, r.exact, r.both_empty, r.missed, r.extra) == (5, 2, 1, 1, 1)
    f1 = [1.0, 1.0, 0.0, 0.0, 0.5]
    assert r.mean_f1 == pytest.approx(statistics.mean(f1)) and r.median_f1 == statistics.median(f1) and r.f1_buckets == [2, 0, 0, 1, 0, 2]
    assert (r.median_size_gold, r.max_size_gold, r.max_size_pred) == (1.0, 2, 2)
    assert (r.n_rows_gold, r.tokens_in_gold, r.tokens_out_gold, r.usd_gold) == (5, 60, 6, pytest.approx((60 * 2 + 6 * 10) / 1e6))
    assert (r.n_rows_pred, r.tokens_in_pred, r.tokens_out_pred, r.usd_pred, r.usd_ratio) == (6, 25, 6, 0.0, None)  # the first row's model has no price
    none = evaluation.agreement_report(g.limit(0), p, prices).first()
    assert (none.n_shared, none.exact, none.mean_f1, none.n_rows_gold, none.usd_gold, none.f1_buckets) == (0, 0, None, 0, 0.0, [0] * 6)
