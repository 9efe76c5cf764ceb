"""Validators that are Python code and raise: bad rows are found by halving Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from batchwright.functions.failures import classify
from batchwright.session import ship_package


def bisect(rows: pd.DataFrame, validate: Callable[[pd.DataFrame], None]) -> list[tuple[str, str] | None]:
    """Of each row None, or the reason and text of what the validator raises for it."""
    try:
        validate(rows)
        return [None] * len(rows)
    except Exception as error:
        if len(rows) == 1:
            return [(classify(error), str(error))]
    half = len(rows) // 2
    return bisect(rows.iloc[:half], validate) + bisect(rows.iloc[half:], validate)


def validated(batch: DataFrame, validate: Callable[[pd.DataFrame], None]) -> DataFrame:
    """The batch with ``reason`` and ``message`` of rows that the validator refuses. It is tried on whole Arrow
    batches and, where it raises, on halves of them: few calls when few rows are bad. When many are, it is called for
    nearly every row, so rows are dealt to all cores first; a small file may be a single task otherwise."""
    ship_package(batch.sparkSession)
    batch = batch.repartition(4 * batch.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = bisect(b.to_pandas(), validate)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string())], names=[*b.schema.names, "reason", "message"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    return batch.mapInArrow(run, f"{kinds}, reason string, message string")
