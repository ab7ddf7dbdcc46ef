"""Processing of rows one by one that keeps failures beside results.

A row is processed or failed, never lost: failed rows stay with an ``error`` and without a result. How many there are of each
is counted in the same pass by an observation: that of the first action on the result (a sort samples its input first, so sort
behind a written table).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, functions as F

INVALID, FAILED = "invalid input", "failed"


def counted(rows: DataFrame, observation: Observation | None) -> DataFrame:
    """``rows`` with the numbers of processed, invalid and failed rows given to ``observation`` while they are computed."""
    if observation is None:
        return rows
    error = F.col("error")
    return rows.observe(
        observation, F.count_if(error.isNull()).alias("processed"), F.count_if(error == INVALID).alias("invalid"), F.count_if(error.isNotNull() & (error != INVALID)).alias("failed"))


def process_rows(rows: DataFrame, valid: Column, attempt: Column, observation: Observation | None = None, name: str = "value") -> DataFrame:
    """Add ``name`` and ``error``. ``attempt`` is an expression of ``try_`` functions: null means that it failed. Rows that are
    not ``valid`` (or where that is unknown) are not tried."""
    ok = F.coalesce(valid, F.lit(False))
    done = rows.withColumn(name, F.when(ok, attempt))
    return counted(done.withColumn("error", F.when(~ok, INVALID).when(F.col(name).isNull(), FAILED)), observation)


def process_with(rows: DataFrame, valid: Column, function: Callable, kind: str, observation: Observation | None = None, name: str = "value") -> DataFrame:
    """The same for a Python function of a row (a dict): what it raises becomes the row's error, and the others go on."""

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            values, errors = [], []
            inputs = batch.drop(columns="_ok").to_dict("records")
            for row, ok in zip(inputs, batch["_ok"], strict=True):
                value = error = None
                if not ok:
                    error = INVALID
                else:
                    try:
                        value = function(row)
                        error = FAILED if value is None else None
                    except Exception as e:  # noqa: BLE001  whatever a user's function raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield batch.drop(columns="_ok").assign(**{name: pd.Series(values, dtype=object, index=batch.index), "error": pd.Series(errors, dtype=object, index=batch.index)})

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    done = rows.withColumn("_ok", F.coalesce(valid, F.lit(False))).mapInPandas(work, f"{fields}, `{name}` {kind}, error string")
    return counted(done, observation)
