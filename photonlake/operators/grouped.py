"""Python over many small groups at once: whole groups reach the function in large frames, not one call each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys."""
    if not len(pdf):
        return np.zeros(0, dtype=int)
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for k in keys:
        v = pdf[k]
        change[1:] |= ~((v.values[1:] == v.values[:-1]) | (v.isna().values[1:] & v.isna().values[:-1]))
    return np.flatnonzero(change)


def map_whole_groups(df: DataFrame, keys: list[str], order: list, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """fn(frame, starts of its groups) over frames of whole groups, rows of a group in ``order``.

    One shuffle by key and a sort; the group that a batch cuts waits for its rest, so memory follows the largest
    group and not the number of groups."""

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = int(group_starts(pdf, keys)[-1])
            held = pdf.iloc[last:].reset_index(drop=True)
            if last:
                done = pdf.iloc[:last]
                yield fn(done, group_starts(done, keys))
        if held is not None and len(held):
            yield fn(held, group_starts(held, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
