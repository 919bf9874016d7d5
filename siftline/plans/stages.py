"""Named stages run in order, each written and read again, with a manifest."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.labeling import Labeler


@dataclass
class Config:
    """Options of a run; unknown keys are rejected, queries and run_dir required.

    Fixed values: the names and what they are unless given.
    """

    queries: str
    run_dir: str
    retriever: str = "tavily"
    scrape_limit: int = 200
    num_results: int = 5
    extract_depth: str = "advanced"
    rpm: int | None = None
    synth_n: int = 2
    synth_limit: int = 0
    provider: str = "bedrock"
    model_id: str | None = None
    prompt_version: str = "v2"
    label_limit: int = 0
    extra_inputs: tuple = ()

    @classmethod
    def of(cls, options: dict, base: str = ".") -> Config:
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown or not {"queries", "run_dir"} <= set(options):
            raise ValueError(f"unknown options {sorted(unknown)}" if unknown else "queries and run_dir are required")
        place = lambda p: p if os.path.isabs(p) else os.path.join(base, p)
        extra = tuple(map(place, options.get("extra_inputs") or ()))
        return cls(**options | {k: place(options[k]) for k in ("queries", "run_dir")} | {"extra_inputs": extra})

    @classmethod
    def of_yaml(cls, path: str) -> Config:
        """The options of a YAML file; relative paths are taken from its folder.  Needs the package ``yaml``."""
        import yaml

        with open(path, encoding="utf-8") as text:
            return cls.of(yaml.safe_load(text) or {}, os.path.dirname(os.path.abspath(path)))


@dataclass
class Stage:
    """A step: ``run`` gets the session and its inputs by name, which are earlier stages or tables read from elsewhere.

    ``options`` are what else its result depends on.
    """

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    inputs: tuple = ()
    options: dict = field(default_factory=dict)


class Files:
    """Small files and folders below a run's folder, wherever Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or, if this dies half way, the one before; never a part of it."""
        partial = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(partial), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self.at(partial), self.at(name)):  # where a file isn't replaced, the old one goes first
            self.delete(name)
            self.fs.rename(self.at(partial), self.at(name))


class Pipeline:
    """Stages with their outputs below ``run_dir``, and a manifest of what each was made from.

    A stage is known by the digest of its name, its options, and the digests of
    its inputs, so a change shows in all that follows.  One without rows, or with
    a missing input, stops the run; what was written stays, with the manifest.
    """

    def __init__(self, stages: list[Stage], run_dir: str, tables: dict[str, str] | None = None):
        self.stages, self.run_dir, self.tables = stages, run_dir, tables or {}
        names = [s.name for s in stages]
        for k, stage in enumerate(stages):
            for name in stage.inputs:
                if name not in names[:k] and name not in self.tables:
                    raise ValueError(f"{stage.name} takes {name}, which is neither an earlier stage nor a table")

    def selected(self, first: str | None = None, last: str | None = None) -> list[Stage]:
        names = [s.name for s in self.stages]
        for name in (first, last):
            if name is not None and name not in names:
                raise ValueError(f"there is no stage {name}")
        a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
        if a > b:
            raise ValueError(f"{first} comes after {last}")
        return self.stages[a : b + 1]

    def folder(self, name: str) -> str:
        return f"{[s.name for s in self.stages].index(name):02d}_{name}"

    def path(self, name: str) -> str:
        return self.tables.get(name) or f"{self.run_dir}/{self.folder(name)}"

    def digests(self) -> dict[str, str]:
        out: dict[str, str] = {name: hashlib.sha1(path.encode()).hexdigest() for name, path in self.tables.items()}
        for s in self.stages:
            parts = [s.name, json.dumps(s.options, sort_keys=True, default=str), *(f"{i}={out[i]}" for i in s.inputs)]
            out[s.name] = hashlib.sha1("\0".join(parts).encode()).hexdigest()
        return out

    def manifest(self, files: Files) -> dict:
        return json.loads(files.read("manifest.json")) if files.exists("manifest.json") else {}

    def plan(self, spark: SparkSession, first: str | None = None, last: str | None = None) -> list[dict]:
        """What a run would do, without doing it: each stage with its inputs, output and state (missing, stale or current)."""
        files, want = Files(spark, self.run_dir), self.digests()
        known, out = self.manifest(files), []
        for s in self.selected(first, last):
            there = files.exists(f"{self.folder(s.name)}/_SUCCESS") and s.name in known
            # current only if nothing in front was written again later
            fresh = there and known[s.name].get("digest") == want[s.name] and all(i in self.tables or known.get(i, {}).get("run") == known[s.name]["from"].get(i) for i in s.inputs)
            out.append({"stage": s.name, "inputs": list(s.inputs), "output": self.path(s.name), "state": "current" if fresh else "stale" if there else "missing"})
        return out

    def run(self, spark: SparkSession, first: str | None = None, last: str | None = None, *, force: bool = False, only_stale: bool = False) -> dict:
        """Run the stages from first to last; returns the manifest of all stages so far.

        With ``only_stale`` stages that are current are left as they are; with
        ``force`` a stage's output is deleted before it runs.
        """
        files, want = Files(spark, self.run_dir), self.digests()
        manifest = self.manifest(files)
        for stage in self.selected(first, last):
            if only_stale and self.plan(spark, stage.name, stage.name)[0]["state"] == "current":
                continue
            inputs = {}
            for name in stage.inputs:
                try:
                    inputs[name] = spark.read.parquet(self.path(name))
                except Exception as e:
                    raise FileNotFoundError(f"{stage.name} needs {name}, which isn't there: run an earlier stage first") from e
            if force:
                files.delete(self.folder(stage.name))
            started = datetime.now(UTC).isoformat(timespec="seconds")
            stage.run(spark, inputs).write.mode("overwrite").parquet(self.path(stage.name))
            rows = spark.read.parquet(self.path(stage.name)).count()
            if not rows:
                manifest.pop(stage.name, None)
                files.put("manifest.json", json.dumps(manifest, indent=1))
                raise RuntimeError(f"{stage.name} gave 0 rows in {self.path(stage.name)}")
            manifest[stage.name] = {
                "inputs": [self.path(i) for i in stage.inputs], "output": self.path(stage.name), "rows": rows, "options": stage.options, "digest": want[stage.name],
                "run": uuid.uuid4().hex, "from": {i: manifest[i]["run"] for i in stage.inputs if i in manifest}, "started": started, "finished": datetime.now(UTC).isoformat(timespec="seconds"),
            }
            files.put("manifest.json", json.dumps(manifest, indent=1, default=str))
        return manifest


def dataset_stages(config: Config, *, scrape: Callable, generate: Callable, labeler: Labeler, extra: tuple[str, ...] = ()) -> list[Stage]:
    """The seven stages from queries to labels without bodies; scraping, generating and labeling are ports.

    ``scrape`` is (session, inputs) to scrape rows with a column ``ord``; ``extra`` are
    tables of label rows that are merged in at the end.
    """
    from siftline.operators import assembly
    from siftline.operators.labeling import label_rows
    from siftline.plans import dataset

    def corpus(_, x):
        return assembly.merge([x["scrape"]], key="doc_id", order="ord", require=["body"])

    def synth(_, x):
        rows = x["segment"].withColumn("topic", F.col("topic").cast("string"))
        return dataset.synth_queries(rows, generate, n=config.synth_n, limit=config.synth_limit)

    def join(_, x):
        units = x["segment"].filter(F.size("units") > 0).select(F.col("doc_id").cast("string").alias("source_doc_id"), "doc_id", "url", "title", "body", "units", "n_units")
        units = assembly.first_seen(units, ["source_doc_id"], ["doc_id"], last=True)
        return x["synth"].withColumnRenamed("qid", "query_id").join(units, "source_doc_id").withColumn("status", F.lit("ok"))

    def label(_, x):
        return label_rows(x["join"], labeler, config.provider, config.model_id or "", config.prompt_version)

    def aggregate(_, x):
        frames = [f.drop("body") for f in (x["label"], *(x[e] for e in extra))]
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f, allowMissingColumns=True)
        return whole

    given = asdict(config)
    some = lambda *names: {n: given[n] for n in names}
    return [
        Stage("scrape", scrape, ("queries",), some("retriever", "scrape_limit", "num_results", "extract_depth", "rpm")),
        Stage("corpus", corpus, ("scrape",)),
        Stage("segment", lambda _, x: dataset.segment_documents(x["corpus"]), ("corpus",)),
        Stage("synth", synth, ("segment",), some("synth_n", "synth_limit", "model_id")),
        Stage("join", join, ("synth", "segment")),
        Stage("label", label, ("join",), some("provider", "model_id", "prompt_version", "label_limit")),
        Stage("aggregate", aggregate, ("label", *extra), {"extra_inputs": list(given["extra_inputs"])}),
    ]
