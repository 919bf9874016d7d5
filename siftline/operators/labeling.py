"""Labels from an external labeler: the port, retries, and reading of its answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.ids import in_range

RETRIES, LONGEST_WAIT = 5, 30


class Retry(Exception):
    """The labeler asks to be called again, after ``wait`` seconds if it says so."""

    def __init__(self, code: str, wait: float | None = None):
        super().__init__(code)
        self.code, self.wait = code, wait


class Refused(Exception):
    """The labeler gives no answer and won't; the text is the status."""


@dataclass
class Answer:
    ids: list[int] | None
    tokens_in: int = 0
    tokens_out: int = 0


#: (query, units) -> Answer; may raise Retry or Refused.
Labeler = Callable[[str, list[str]], Answer]


def call(labeler: Labeler, query: str, units: list[str], sleep: Callable[[float], None] = time.sleep) -> tuple[str, Answer]:
    """(status, answer): ok, what was refused, or error:<code> after RETRIES further calls."""
    for attempt in range(RETRIES + 1):
        try:
            return "ok", labeler(query, units)
        except Refused as e:
            return str(e), Answer(None)
        except Retry as e:
            if attempt == RETRIES:
                return f"error:{e.code}", Answer(None)
            # a wait of 0 says nothing; the first wait is of two seconds
            sleep(e.wait or min(2 ** (attempt + 1), LONGEST_WAIT))
        except Exception:  # noqa: BLE001  an unknown failure is data, it must not end the job
            return "error:unhandled", Answer(None)
    raise AssertionError


def overlap_labeler(least: int = 2) -> Labeler:
    """A rule instead of a model: units that share so many words with the query."""

    def label(query: str, units: list[str]) -> Answer:
        asked = set(query.lower().split())
        return Answer([i for i, u in enumerate(units) if len(asked & set(u.lower().split())) >= least])

    return label


def label_rows(df: DataFrame, labeler: Labeler, provider: str, model: str, version: str) -> DataFrame:
    """Rows that can be judged, with relevant_unit_ids (null on failure), status and identity of the labeler."""
    rows = df.filter((F.col("status") == "ok") & (F.size("units") > 0) & (F.col("query") != "")).drop("relevant_unit_ids", "status", "tokens_in", "tokens_out", "latency_s")
    schema = rows.withColumns({"relevant_unit_ids": F.lit(None).cast("array<int>"), "status": F.lit(""), "tokens_in": F.lit(0).cast("long"), "tokens_out": F.lit(0).cast("long"), "latency_s": F.lit(0.0)}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, units in zip(batch["query"], batch["units"], strict=True):
                began = time.monotonic()
                status, a = call(labeler, query, list(units))
                valid = None if a.ids is None else sorted({i for i in a.ids if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < len(units)})
                out.append((valid, status, a.tokens_in, a.tokens_out, round(time.monotonic() - began, 3)))
            new = pd.DataFrame(out, columns=["relevant_unit_ids", "status", "tokens_in", "tokens_out", "latency_s"], index=batch.index)
            yield pd.concat([batch, new], axis=1)

    return rows.mapInPandas(run, schema).withColumns({"labeler_provider": F.lit(provider), "labeler_model": F.lit(model), "prompt_version": F.lit(version)})


def parse_answer(raw: Column, n: Column, finish: Column | None = None) -> Column:
    """{ids, status} of a JSON answer: an object with relevant_unit_ids, or a bare list of ids.

    Cut off answers are error:truncated, text that isn't JSON error:invalid_json,
    other JSON error:schema_shape.
    """
    listed = F.from_json(raw, "array<int>", {"mode": "PERMISSIVE"})
    inner = F.get_json_object(raw, "$.relevant_unit_ids")
    ids = F.when(F.trim(raw).startswith("["), listed).when(F.trim(inner).startswith("["), F.from_json(inner, "array<int>"))
    valid_json = F.get_json_object(F.concat(F.lit('{"a":'), raw, F.lit("}")), "$.a").isNotNull()
    status = F.lit("error:schema_shape")
    status = F.when(ids.isNotNull(), F.lit("ok")).when(valid_json, status).otherwise(F.lit("error:invalid_json"))
    if finish is not None:
        status = F.when(finish == "length", F.lit("error:truncated")).otherwise(status)
    return F.struct(F.when(status == "ok", F.array_sort(F.array_distinct(in_range(ids, n)))).alias("ids"), status.alias("status"))
