"""Folds whose state runs through a series, streamed in order over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def streamed(df: DataFrame, k: str, columns: list[str], step: Callable, out: str, end: Callable | None = None) -> DataFrame:
    """k and ``out``: what ``step`` emits along each key's rows, ordered by ``columns``.

    step(state, row) gives the next state and a list of rows to emit; the state is None before a key's first row.
    end(state) gives rows to emit after its last. A partition's rows pass in sorted order, batch by batch, so that no
    key is held whole; memory is one batch and one state. Null keys are a key of their own; no rows give none.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, None, False
        for batch in batches:
            made: list[tuple] = []
            for own, *row in batch[[k, *columns]].itertuples(index=False, name=None):
                same = begun and (own == key or (pd.isna(own) and pd.isna(key)))
                if not same:
                    if begun and end:
                        made += [(key, *x) for x in end(state)]
                    key, state, begun = own, None, True
                state, rows = step(state, row)
                made += [(key, *x) for x in rows]
            yield pd.DataFrame(made, columns=[k, *names])
        if begun and end:
            yield pd.DataFrame([(key, *x) for x in end(state)], columns=[k, *names])

    return df.select(k, *columns).repartition(k).sortWithinPartitions(k, *columns).mapInPandas(run, f"{k} {dict(df.dtypes)[k]}, {out}")
