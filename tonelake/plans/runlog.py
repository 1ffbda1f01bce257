"""Stages run one after the other, with one JSON line of what each one made.

The counts come from ``DataFrame.observe``, so they are taken while a stage writes its table; no stage is run twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonelake.plans.resumable import put_file
from tonelake.sources.shared import materialize

LINE = "run string, number int, stage string, rows long, seconds double, problem string, marks map<string,double>"


def run(first: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], path: str, name: str, marks: dict[str, Column] | None = None) -> DataFrame:
    """The last stage's table. Every stage is stored before the next one reads it.

    A finished stage leaves a line with its rows, its seconds and the aggregates ``marks`` over the columns that it has; a stage
    that fails leaves one with its problem, and the error goes on to the caller.
    """
    spark, df = first.sparkSession, first
    for number, (stage, make) in enumerate(stages):
        started, told = time.time(), {"run": name, "number": number, "stage": stage}
        try:
            out, seen = make(df), Observation()
            own = {k: c for k, c in (marks or {}).items() if _fits(out, c)}
            df = materialize(out.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(k) for k, c in own.items()]), f"stage-{number}")
            got = seen.get
            told |= {"rows": got["rows"], "marks": {k: got[k] for k in own if got[k] is not None}}
        except Exception as problem:
            told["problem"] = f"{type(problem).__name__}: {str(problem).splitlines()[0][:300]}" if str(problem) else type(problem).__name__
            raise
        finally:
            told["seconds"] = round(time.time() - started, 3)
            put_file(spark, f"{path}/{name}-{number:04d}.json", json.dumps(told) + "\n")
    return df


def _fits(df: DataFrame, mark: Column) -> bool:
    try:
        df.agg(mark).schema
    except Exception:  # a stage without the column; analysis refuses it before anything runs
        return False
    return True


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``LINE`` rows of every run in the folder."""
    return spark.read.schema(LINE).json(f"{path}/*.json")
