"""Models applied to rows: one callback a worker, timed, with errors as codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.05, 0.90


def confidence(value: float) -> float:
    """The threshold asked for, if it is in the range allowed."""
    if not LEAST_CONFIDENCE <= float(value) <= MOST_CONFIDENCE:
        raise ValueError(f"confidence must be from {LEAST_CONFIDENCE} to {MOST_CONFIDENCE}")
    return float(value)


def predict(rows: DataFrame, key: str, payload: str, load: Callable[[], Callable[[object], list[dict]]]) -> DataFrame:
    """(key, results, seconds, error): what the model says of each payload, as JSON.

    `load` runs once a task and gives the model as a function. An error gives the name of its class and no message, as messages may hold secrets; other
    rows go on.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import time

        model = load()
        for batch in batches:
            out = []
            for k, value in zip(batch[key], batch[payload]):
                began = time.perf_counter()
                try:
                    results, error = json.dumps(model(value), sort_keys=True), None
                except Exception as e:
                    results, error = None, type(e).__name__
                out.append((k, results, time.perf_counter() - began, error))
            yield pd.DataFrame(out, columns=[key, "results", "seconds", "error"])

    return rows.select(key, payload).mapInPandas(run, f"{key} {kind}, results string, seconds double, error string")


def timing(predictions: DataFrame) -> DataFrame:
    """One row: images, failures, total and mean seconds."""
    return predictions.selectExpr("count(*) AS images", "count(error) AS failures", "coalesce(sum(seconds), 0) AS total_seconds", "avg(seconds) AS mean_seconds")
