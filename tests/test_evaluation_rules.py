"""Rules of the evaluation stages on rows that repeat keys or lack values."""

import math

from siftline.operators import metrics
from siftline.plans import dataset, evaluation


def test_last_rows_and_fallback_intents(spark):
    results = spark.createDataFrame([("p", 1, "q", "", [("u", ["a b"]), ("w", None)]), ("p", 2, "q", None, [("u", ["a"])])], "provider string, query_id int, query string, intent string, docs array<struct<url: string, snippets: array<string>>>")
    bodies = spark.createDataFrame([("u", "error", 1), ("u", "ok", 2)], "url string, status string, ord int")
    gold = spark.createDataFrame([("1", "u", "ok", [0], "a b c", ["a b c"], 1), ("1", "u", "ok", [0], "a", ["a"], 2)], "query_id string, url string, status string, gold_unit_ids array<int>, gold_text string, units array<string>, ord int")
    queries = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "qid int, intent string, ord int")
    got = {(r.query_id, r.url): (r.intent, r.body_status, r.gold_status, r.gold_text, r.n_gold, r.n_overlap) for r in evaluation.doc_eval(results, bodies, gold, queries).collect()}
    assert got == {("1", "u"): ("new", "ok", "ok", "a", 1, 1), ("1", "w"): ("new", "missing", "missing", "", 0, 0), ("2", "u"): (None, "ok", "missing", "", 0, 0)}


def test_summary(spark):
    rows = [("p", "x", True, True, 1.0, 3, 2), ("p", "", False, True, 0.5, 5, 0), ("p", None, True, False, 0.0, 9, 9), ("p", "x", False, False, 0.0, 9, 9)]
    df = spark.createDataFrame([(*r[:4], r[4], r[4], r[4], *r[5:]) for r in rows], "provider string, intent string, has_body boolean, has_gold boolean, precision double, recall double, f1 double, n_pred long, n_gold long")
    got = {r.intent: r for r in metrics.summary(df, "provider", "intent").collect()}
    assert set(got) == {None, "x", "?"}
    whole = got[None]
    assert (whole.n_docs, whole.n_scored, whole.n_no_body, whole.n_no_gold, whole.n_gold_empty) == (4, 2, 2, 1, 1)
    assert (whole.f1, whole.median_pred, whole.median_gold) == (0.75, 4.0, 1.0)
    assert (got["?"].n_docs, got["?"].n_scored, got["?"].f1) == (2, 1, 0.5)
    none = metrics.summary(df.filter("NOT has_gold"), "provider", "intent").first()
    assert math.isnan(none.f1) and none.n_scored == 0


def test_blank_bodies(spark):
    queries = spark.createDataFrame([(1, "q", 0)], "query_id int, query string, ord int")
    results = spark.createDataFrame([(1, 0, "http://a", "t", " \n "), (1, 1, "http://b", "t", "A body.")], "query_id int, rank int, url string, title string, body string")
    got = {r.url: (r.body, r.status) for r in dataset.scrape(queries, results, dataset.RETRIEVERS["firecrawl"]).collect()}
    assert got == {"http://a": ("", "skipped:empty_md"), "http://b": ("A body.", "ok")}
