"""Rows brought together by key and read in batches of many whole groups, where a call of pandas for each small group would cost the most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


def gathered(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The rows, each key's in one partition and one after the other, for `whole`."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has another key than the row before; nulls are equal."""
    out = np.zeros(max(len(frame) - 1, 0), bool)
    for k in keys:
        a, none = frame[k].to_numpy(), frame[k].isna().to_numpy()
        out |= (a[1:] != a[:-1]) & ~(none[1:] & none[:-1])
    return out


def starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places at which the groups of a frame begin."""
    return np.flatnonzero(np.append(len(frame) > 0, _starts(frame, keys)))


def whole(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups: the last group of a batch waits for the next one, so a batch and one group are held."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        joint = pd.concat([held[-1][keys].iloc[-1:], frame[keys]]) if held else frame[keys]
        new = np.flatnonzero(_starts(joint, keys)) + (0 if held else 1)
        if len(new):
            yield pd.concat([*held, frame.iloc[: new[-1]]], ignore_index=True)
            held, frame = [], frame.iloc[new[-1] :]
        held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)
