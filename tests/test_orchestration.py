"""A run of all stages with stubbed ports: plan, staleness, force, what stops it, and the manifest."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.operators.labeling import overlap_labeler
from siftline.plans import stages

ORDER = ["scrape", "corpus", "segment", "synth", "join", "label", "aggregate"]


def doc(k, doc_id, body):
    return (k, doc_id, "tavily", "seed q", "q1", None, "procedural", f"https://x/{doc_id}", "t", body, 1, "ok")


ROWS = [doc(0, "D1", "First sentence about cats. Second sentence about cats."), doc(1, "D1", "DUPLICATE doc, must lose"), doc(2, "D2", "Dogs are loyal animals. They bark a lot."), doc(3, "D3", "")]
SCHEMA = "ord int, doc_id string, origin string, query string, query_id string, topic string, intent string, url string, title string, body string, position int, status string"


def build(spark, folder, rows=ROWS, extra=(), **options):
    spark.createDataFrame([("q1", "seed q")], "qid string, query string").write.mode("overwrite").parquet(f"{folder}/queries")
    config = stages.Config.of({"queries": f"{folder}/queries", "run_dir": f"{folder}/run"} | options)
    calls = []

    def scrape(session, inputs):
        calls.append(inputs["queries"].count())
        return session.createDataFrame(rows, SCHEMA)

    generate = lambda p: F.lit("definitional ||| what about this then\ncomparative ||| about cats and dogs")
    tables = {"queries": config.queries} | {f"extra{k}": p for k, p in enumerate(extra)}
    made = stages.dataset_stages(config, scrape=scrape, generate=generate, labeler=overlap_labeler(1), extra=tuple(f"extra{k}" for k in range(len(extra))))
    return stages.Pipeline(made, config.run_dir, tables), calls


def states(pipeline, spark):
    return {x["stage"]: x["state"] for x in pipeline.plan(spark)}


def test_all_stages(spark, tmp_path):
    extra = str(tmp_path / "extra")
    spark.createDataFrame([("ms", "D9", "gone", [1])], "query_id string, doc_id string, body string, relevant_unit_ids array<int>").write.parquet(extra)
    pipeline, calls = build(spark, tmp_path, extra=(extra,))
    assert [s.name for s in pipeline.stages] == ORDER and pipeline.path("synth").endswith("run/03_synth")
    assert states(pipeline, spark) == dict.fromkeys(ORDER, "missing") and not calls and not (tmp_path / "run").exists(), "a plan runs nothing"
    manifest = pipeline.run(spark)
    assert list(manifest) == ORDER and manifest == json.loads((tmp_path / "run" / "manifest.json").read_text())
    read = lambda name: spark.read.parquet(pipeline.path(name))
    assert {(r.doc_id, r.body) for r in read("corpus").collect()} == {(x[1], x[9]) for x in (ROWS[0], ROWS[2])}
    assert manifest["corpus"]["rows"] == 2 and manifest["synth"]["rows"] == 4
    assert {r.n_units for r in read("segment").collect()} == {2}
    assert "body" not in read("aggregate").columns and manifest["aggregate"]["rows"] == 5
    assert {(r.source_doc_id, tuple(r.relevant_unit_ids)) for r in read("label").filter("intent = 'comparative'").collect()} >= {("D1", (0, 1))}
    assert states(pipeline, spark) == dict.fromkeys(ORDER, "current")
    assert not [p for p in (tmp_path / "run").iterdir() if p.name.startswith("manifest.json.")]

    assert pipeline.run(spark, only_stale=True) == manifest and calls == [1], "nothing is stale"
    changed, more = build(spark, tmp_path, extra=(extra,), synth_n=1)
    assert states(changed, spark) == dict.fromkeys(ORDER[:3], "current") | dict.fromkeys(ORDER[3:], "stale")
    again = changed.run(spark, only_stale=True)
    assert not more and again["corpus"] == manifest["corpus"] and again["synth"]["rows"] == 2 and states(changed, spark) == dict.fromkeys(ORDER, "current")
    changed.run(spark, "segment", "segment", force=True)
    assert states(changed, spark) == dict.fromkeys(ORDER[:3], "current") | dict(synth="stale", join="stale", label="current", aggregate="current"), "what was made from the old segments"


def test_what_stops_a_run(spark, tmp_path):
    pipeline, _ = build(spark, tmp_path)
    with pytest.raises(FileNotFoundError, match="corpus needs scrape"):
        pipeline.run(spark, "corpus")
    for bad in (("label", "segment"), ("nowhere", None)):
        with pytest.raises(ValueError):
            pipeline.selected(*bad)
    assert [s.name for s in pipeline.selected("segment", "label")] == ORDER[2:6]
    empty, _ = build(spark, tmp_path, rows=[])
    with pytest.raises(RuntimeError, match="0 rows"):
        empty.run(spark)
    assert states(empty, spark)["scrape"] == "missing"
    with pytest.raises(ValueError, match="neither"):
        stages.Pipeline([stages.Stage("a", None, ("b",))], "x")


def test_options(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"queries": "data/seed", "run_dir": "runs/x", "extra_inputs": ["more/y"]}))
    config = stages.Config.of_yaml(str(tmp_path / "c.yaml"))
    assert config.queries == f"{tmp_path}/data/seed" and config.extra_inputs == (f"{tmp_path}/more/y",) and config.retriever == "tavily"
    for bad in ({"queries": "a", "run_dir": "b", "nope": 1}, {"retriever": "tavily"}):
        with pytest.raises(ValueError):
            stages.Config.of(bad)
