"""JSON lines, retrieval TSV files and split folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(df: DataFrame) -> DataFrame:
    """Adds file_name and ord; ord rises along each file."""
    return df.withColumns({"file_name": F.input_file_name(), "ord": F.monotonically_increasing_id()})


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, *, skip_bad: bool = False) -> DataFrame:
    """Rows of JSON-lines files; blank lines go; a bad line raises, or goes with ``skip_bad``."""
    return ordered(spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").json(path))


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """read_jsonl, without rows where the path is missing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return read_jsonl(spark, path, schema)
    return ordered(spark.createDataFrame([], schema))


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, iter, docid, rel of white-space separated lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= 4).select(parts[0].cast("long").alias("qid"), parts[1].cast("int").alias("iter"), parts[2].alias("docid"), parts[3].cast("int").alias("rel"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid and query of tab-separated lines without quoting; bad lines go."""
    return spark.read.csv(path, sep="\t", quote="", mode="DROPMALFORMED", schema="qid long, query string")


def read_documents(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """docid, url, title, body of lines with exactly four fields; only needed documents if given."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).filter(F.size(parts) == 4).select(*(parts[i].alias(n) for i, n in enumerate(("docid", "url", "title", "body"))))
    return rows if needed is None else rows.join(needed.select("docid").distinct(), "docid", "left_semi")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid and the ranked docids of a (gzipped) run of at least six fields a line."""
    rows = ordered(spark.read.text(path))
    parts = F.split(F.trim("value"), r"\s+")
    rows = rows.filter(F.size(parts) >= 6).select(parts[0].cast("long").alias("qid"), parts[2].alias("docid"), "ord")
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "docid"))), lambda x: x["docid"]).alias("docids"))


def write_splits(df: DataFrame, path: str) -> None:
    """A folder for each value of split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; null relevant ids become empty, source defaults to the file."""
    rows = spark.read.parquet(path).filter(F.col("split") == split)
    return rows.withColumns({"relevant_unit_ids": F.coalesce("relevant_unit_ids", F.array().cast("array<int>")), "source": F.coalesce("source", F.input_file_name())})


def unify(results: dict[str, DataFrame]) -> DataFrame:
    """Provider results (query_id, docs) under one schema: provider, query_id, url, snippets, score, title."""
    frames = []
    for provider, df in results.items():
        rows = df.select("query_id", F.explode("docs").alias("d"))
        fields = {f.name for f in rows.schema["d"].dataType.fields}
        snippets = next((F.col(f"d.{n}") for n in ("snippets", "highlights", "chunks") if n in fields), F.array().cast("array<string>"))
        score = F.col("d.score").cast("double") if "score" in fields else F.lit(None).cast("double")
        title = F.col("d.title") if "title" in fields else F.lit(None).cast("string")
        frames.append(rows.select(F.lit(provider).alias("provider"), "query_id", F.col("d.url").alias("url"), F.array_distinct(F.filter(snippets, lambda s: s != "")).alias("snippets"), score.alias("score"), title.alias("title")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
