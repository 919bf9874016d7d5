"""Synthesis per document and the sample of judged pairs against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from siftline.plans import dataset

INTENTS = {"definitional", "procedural", "comparative", "debugging", "best-practice", "enumeration"}


def brute(rows, answer, n, done=(), limit=0):
    """rows: (ord, query_id, doc_id, status, query, intent, topic, body)."""
    seen, taken, out = set(), [], []
    for _, q, d, status, query, intent, topic, body in sorted(rows, key=lambda r: r[0]):
        if status == "ok" and body and query and (q, d) not in seen:
            seen.add((q, d))
            if (q, d) not in done:
                taken.append((q, d, intent, topic, body))
    for q, d, intent, topic, body in taken[:limit] if limit else taken:
        had = (intent or "").lower()
        had = had if had in INTENTS else "procedural"
        got = {}
        for line in answer(body).splitlines():
            line = re.sub(r"^([-*+]|\d+[.)])\s+", "", line.strip())
            left, mark, right = line.partition("|||")
            kind, text = left.strip().lower(), right.strip().strip('"').strip("'")
            if mark and kind in INTENTS and kind != had and kind not in got and 3 <= len(text.split()) <= 20 and len(got) < n:
                got[kind] = text
        for kind, text in got.items():
            h = int(hashlib.sha1("\0".join((q, d, kind, text)).encode()).hexdigest()[:15], 16) % 10**12
            out.append((f"syn_pd_{h:012d}", text, topic, "synthesized from doc", kind, q, d))
    return sorted(out, key=repr)


ANSWER = """- Comparative ||| {} one two three
 2) debugging ||| "'how to fix {}'"
debugging ||| how to fix it again
"procedural ||| a quoted line here"
no line
of no kind ||| a b c d
enumeration ||| too short
procedural ||| what to do with {} ||| and more
definitional|||""" + " word" * 21 + "\n\ndefinitional ||| what is {} then"
SCHEMA = "ord long, query_id string, doc_id string, status string, query string, intent string, topic string, body string"
ROWS = [
    (1, "q1", "d1", "ok", "x", None, "t", "same"), (2, "q1", "d2", "ok", "x", "DEBUGGING", None, "same"), (3, "q2", "d1", "ok", "x", " debugging ", "t", "same"), (0, "q1", "d1", "error", "x", None, "t", "other"), (4, "q1", "d1", "ok", "x", None, "late", "late"),
    (5, "q3", "d3", "ok", "", None, "t", "b"), (6, "q3", "d3", "ok", "y", "comparative", "t", None), (7, "q3", "d3", "ok", "y", "comparative", "t", "third"), (8, "q4", "d4", None, "y", None, "t", "b"), (9, "q5", "d5", "ok", "y", "new", "t", "done"),
]


def test_queries_of_documents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    done = spark.createDataFrame([("q5", "d5"), ("", "d1"), (None, "d1"), ("q9", "d1")], "source_query_id string, source_doc_id string")
    generate = lambda p: F.regexp_replace(F.lit(ANSWER), r"\{\}", F.regexp_replace(p, r"(?s)^.*\nDOCUMENT:\n", ""))
    python = lambda body: ANSWER.replace("{}", body)
    for n, limit in ((2, 0), (5, 0), (2, 2)):
        got = sorted((tuple(r) for r in dataset.synth_queries(df, generate, n=n, limit=limit, done=done).collect()), key=repr)
        assert got == brute(ROWS, python, n, {("q5", "d5")}, limit)
    assert len({r[1] for r in got}) < len(got), "documents with the same query keep it each"
    assert dataset.synth_queries(df.limit(0), generate).collect() == []


def test_judged_pairs_keep_all_documents_of_a_query(spark):
    rows = [(q, d) for q in range(6) for d in "abcd"] + [(1, "a"), (2, "b")]
    qrels = spark.createDataFrame(rows, "qid int, docid string")
    queries = spark.createDataFrame([(q, f"text {q}") for q in range(5)], "qid int, query string")
    exclude = spark.createDataFrame([("1", "a"), ("3", "c"), ("9", "z")], "qid string, docid string")
    place = lambda r: hashlib.sha1(f"42\0{r[0]}-{r[1]}".encode()).hexdigest()
    for n, over in ((3, 2), (4, 4), (100, 1)):
        drawn = sorted(rows, key=place)[: n * over]
        want = list(dict.fromkeys(r for r in drawn if r not in {(1, "a"), (3, "c")}))[:n]
        got = [tuple(r) for r in dataset.judged_pairs(qrels, queries, n=n, oversample=over, exclude=exclude).select("qid", "docid", "query").collect()]
        assert got == [(q, d, f"text {q}" if q < 5 else None) for q, d in want]
