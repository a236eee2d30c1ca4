"""User functions over rows: models, engines and judges that this library does not have.

An engine is made by a function without arguments, once in each Python worker, and called row by row. A row that fails is
tried again and then becomes a row with an error; others go on. Calls are dealt over `tasks` partitions, which bounds how
many run at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ENGINES: dict[str, Callable] = {}


def engine_of(name: str, make: Callable[[], Callable]) -> Callable:
    """This worker's engine of that name."""
    if name not in _ENGINES:
        _ENGINES[name] = make()
    return _ENGINES[name]


def call_rows(
    rows: DataFrame, name: str, make: Callable[[], Callable], columns: list[str], out: str, kind: str,
    retries: int = 1, wait: float = 0.0, tasks: int | None = None,
) -> DataFrame:
    """`rows` with `out`, what engine(*columns) gives (of type `kind`), and `error`: null, or what the last try failed with.

    Before the next try it waits `wait` seconds times the number of tries so far.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DataType.fromDDL(kind)), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, errors = [], []
            for values in zip(*[batch[c] for c in columns]):
                found = error = None
                for attempt in range(1, retries + 1):
                    try:
                        found, error = engine_of(name, make)(*values), None
                        break
                    except Exception as failed:  # whatever a user's engine raises is this row's error
                        error = f"{type(failed).__name__}: {failed}"
                        if attempt < retries and wait:
                            time.sleep(wait * attempt)
                made.append(found)
                errors.append(error)
            batch[out], batch["error"] = pd.Series(made, batch.index, dtype=object), pd.Series(errors, batch.index, dtype=object)
            yield batch

    return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, schema)
