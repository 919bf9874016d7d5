"""Contracts of the compression operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import ids, text
from siftline.functions.segment import units
from siftline.operators import align, assembly, labeling, metrics, scoring, windows
from siftline.plans import stages
from siftline.sources import files


def value(spark, column, **columns):
    names = list(columns)
    kinds = {list: "array<int>", str: "string", int: "int", float: "double"}

    def kind(v):
        if isinstance(v, list):
            return "array<string>" if v and isinstance(v[0], str) else "array<double>" if v and isinstance(v[0], float) else "array<int>"
        return kinds[type(v)]

    schema = ", ".join(f"{n} {kind(columns[n])}" for n in names) or "x int"
    row = [tuple(columns.values()) or (1,)]
    return spark.createDataFrame(row, schema).select(column.alias("v")).first()["v"]


def test_spans_and_windows(spark):
    assert [tuple(x) for x in value(spark, windows.spans(F.col("u")), u=["a", "b", "c"])] == [(0, 1), (2, 3), (4, 5)]
    packs = lambda lens, cap: value(spark, windows.pack_windows(F.col("n"), cap), n=lens)
    assert packs([3, 3, 3, 3], 6) == [0, 0, 1, 1]
    assert packs([2, 10, 2], 5) == [0, 1, 2]
    assert packs([10, 2, 2], 5) == [0, 1, 1]
    assert packs([], 5) == []
    with pytest.raises(ValueError):
        windows.pack_windows(F.col("n"), 0)


def test_budget(spark):
    take = lambda s, c, b: value(spark, windows.select_under_budget(F.col("s"), F.col("c"), b), s=s, c=c)
    assert take([0.9, 0.3, 0.8, 0.7], [1, 1, 1, 1], 2) == [0, 2]
    assert take([0.9, 0.6, 0.5], [3, 1, 1], 1) == [1]
    assert take([0.05], [1], 9) == []
    rnd = random.Random(7)
    for _ in range(10):
        s, c, b = [round(rnd.random(), 1) for _ in range(9)], [rnd.randint(1, 9) for _ in range(9)], rnd.randint(1, 30)
        want, used = [], 0
        for i in sorted(range(9), key=lambda i: (-s[i], i)):
            if s[i] >= 0.1 and used + c[i] <= b:
                want.append(i)
                used += c[i]
        assert take(s, c, b) == sorted(want)


def test_render_ratio_and_ids(spark):
    u = ["u0", "u1", "u2", "u3"]
    assert value(spark, ids.render(F.col("u"), F.col("k")), u=u, k=[0, 1, 3]) == "u0 u1 [...] u3"
    assert value(spark, ids.render(F.col("u"), F.col("k")), u=u, k=[]) == ""
    anchor = lambda i, a: value(spark, ids.merge_anchor(F.col("i"), F.lit(a), F.lit(10)), i=i)
    assert (anchor([3, 1], 0), anchor([], 0), anchor([2, 99, -1], 50)) == ([0, 1, 3], [], [2])
    assert value(spark, ids.superset(F.array(F.lit(3), F.lit(4)), F.array(F.lit(1), F.lit(3)))) == [1, 3, 4]


def test_plain_tokens(spark):
    assert value(spark, text.tokens(F.lit("Café, straße!"))) == ["cafe", "strae"]
    assert value(spark, text.fragments(F.lit("a long one [...] tiny [ ... ] another one"))) == ["a long one", "another one"]


def test_prf_conventions(spark):
    df = spark.createDataFrame([(0, "a b c d e f", "a b c d e x y z"), (1, "", ""), (2, "", "a"), (3, "a", ""), (4, None, "b b")], "k int, p string, g string")
    got = {r.k: (r.precision, r.recall, r.n_overlap) for r in metrics.token_prf(df, ["k"], "p", "g").collect()}
    assert got == {0: (5 / 6, 5 / 8, 5), 1: (1, 1, 0), 2: (1, 0, 0), 3: (0, 1, 0), 4: (1, 0, 0)}


def test_pooling(spark):
    u = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, unit_id int")
    p = spark.createDataFrame([(1, 0, x) for x in (0.9, 0.9, 0.1, 0.9)], "doc_id int, unit_id int, p double")
    got = {r.unit_id: (round(r.mean, 9), r.score, r.kept) for r in scoring.pool(u, p, ["doc_id", "unit_id"]).collect()}
    assert got == {0: (0.7, 0.75, True), 1: (0.0, 0.0, False)}


def test_compress(spark):
    df = spark.createDataFrame([(1, "red fox", ["the red fox", "blue sky", "a red fox ran"]), (2, None, []), (3, "x", None)], "id int, query string, units array<string>")
    got = {r.id: (r.kept_ids, r.snippet) for r in scoring.compress(df, threshold=0.5).collect()}
    assert got[1] == ([0, 2], "the red fox [...] a red fox ran") and got[2][0] == [] and got[3][0] == []


def test_merge_keeps_the_first_with_required_fields(spark):
    a = spark.createDataFrame([("D1", "a", 0), ("D2", "", 1)], "doc_id string, body string, ord int")
    b = spark.createDataFrame([("D1", "b", 0), ("D3", "c", 1)], "doc_id string, body string, ord int")
    got = assembly.merge([a, b], key="doc_id", order="ord", require=["body"], keep=["doc_id", "body", "url"]).collect()
    assert sorted(map(tuple, got), key=str) == [("D1", "a", None), ("D3", "c", None)]


def test_resume(spark):
    rows = spark.createDataFrame([("1", "D1"), ("2", "D2")], "query_id string, doc_id string")
    done = spark.createDataFrame([(1, "D1", None, "m", "v2"), (2, "D2", "azure", "other", "v2")], "query_id int, doc_id string, labeler_provider string, labeler_model string, prompt_version string")
    assert [r.query_id for r in assembly.pending_labels(rows, done, "azure", "m", "v2").collect()] == ["2"]


def test_align(spark):
    units_ = ["alpha beta gamma delta epsilon zeta eta", "nothing of this kind is here at all", "one two three four five six seven eight"]
    f = spark.createDataFrame([(1, 0, units_[0]), (1, 1, units_[2]), (1, 2, "short"), (2, 0, "wholly other words that are not in there")], "k int, frag_id int, fragment string")
    u = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(units_)], "k int, unit_id int, unit string")
    got = {r.k: (r.unit_ids, r.n_fragments, r.n_matched) for r in align.align(f, u, ["k"]).collect()}
    assert got == {1: ([0, 2], 3, 2), 2: ([], 1, 0)}


def test_segmenter():
    assert units("One here. Two there!") == ["One here.", "Two there!"]
    assert units("```\na\n\n  b\n```\n\n# Head\ntext") == ["```\na\n\n  b\n```", "# Head", "text"]
    assert units("| a | b |\n|---|---|\n| [x](u) | 2 |") == ["| a | b |\n|---|---|\n| [x](u) | 2 |"]
    assert units("- one\n  - inner\n- two\n\n> said so\n\n---\n") == ["- one\n  - inner", "- two", "said so"]
    assert units("a &amp; b. [edit]") == ["a & b."] and units("  ") == [] and units(None) == []
    assert all(len(u.split()) <= 250 for u in units("word " * 600)) and len(units("word " * 600)) == 6


def test_labeler_retries(spark):
    calls = []

    def flaky(query, units_):
        calls.append(1)
        if len(calls) < 3:
            raise labeling.Retry("rate_limit")
        return labeling.Answer([0])

    assert labeling.call(flaky, "q", ["u"], lambda s: None)[0] == "ok" and len(calls) == 3

    def never(query, units_):
        raise labeling.Retry("rate_limit", 0)

    assert labeling.call(never, "q", ["u"], lambda s: None) == ("error:rate_limit", labeling.Answer(None))
    df = spark.createDataFrame([("ok", "red fox", ["a red fox", "sky"]), ("bad", "x", ["y"])], "status string, query string, units array<string>")
    got = labeling.label_rows(df, labeling.overlap_labeler(), "rule", "overlap", "v1").collect()
    assert [(r.relevant_unit_ids, r.status) for r in got] == [([0], "ok")]


def test_parse_answer(spark):
    raw = ["[1, 0, 9]", '{"relevant_unit_ids": [1]}', "no json", '"text"', "[1"]
    df = spark.createDataFrame([(i, r, "length" if i == 4 else "stop") for i, r in enumerate(raw)], "i int, raw string, finish string")
    got = {r.i: (r.a.ids, r.a.status) for r in df.select("i", labeling.parse_answer(F.col("raw"), F.lit(3), F.col("finish")).alias("a")).collect()}
    assert got == {0: ([0, 1], "ok"), 1: ([1], "ok"), 2: (None, "error:invalid_json"), 3: (None, "error:schema_shape"), 4: (None, "error:truncated")}


def test_stages(spark, tmp_path):
    one = stages.Stage("one", lambda s, i: s.range(3))
    two = stages.Stage("two", lambda s, i: i["one"].filter("id > 0"), ("one",))
    empty = stages.Stage("empty", lambda s, i: i["two"].limit(0), ("two",))
    p = stages.Pipeline([one, two, empty], str(tmp_path))
    with pytest.raises(FileNotFoundError):
        p.run(spark, "two", "two")
    assert p.run(spark, last="two")["two"]["rows"] == 2
    with pytest.raises(RuntimeError):
        p.run(spark, "empty")
    with pytest.raises(ValueError):
        stages.Config.of({"queries": "q", "run_dir": "r", "other": 1})
    assert stages.Config.of({"queries": "q", "run_dir": "/r"}, "/b").queries == "/b/q"


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "1"}\n\n{"q": "2"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([], "q string").schema).count() == 2
    assert files.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), spark.createDataFrame([], "q string").schema).count() == 0
    (tmp_path / "qrels").write_text("1 0 D1 1\n2\t0 D2  0\n")
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [(1, 0, "D1", 1), (2, 0, "D2", 0)]
    (tmp_path / "run").write_text("1 Q0 D5 1 9.0 x\n1 Q0 D3 2 8.0 x\nbad\n")
    assert files.read_run(spark, str(tmp_path / "run")).first().docids == ["D5", "D3"]
    (tmp_path / "docs").write_text("D1\tu\tt\tb\nD2\tu\tt\n")
    assert [r.docid for r in files.read_documents(spark, str(tmp_path / "docs")).collect()] == ["D1"]
