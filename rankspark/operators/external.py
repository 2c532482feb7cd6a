"""Models of others: rows are given to them in batches of an exact size, and rows that they fail on are told apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: name -> a function that makes a scorer; it is called once a task, so that a model is loaded there.
SCORERS: dict[str, Callable[[], Callable[[pd.DataFrame], Sequence[float]]]] = {}


def scorer(name: str):
    """Register a maker of scorers by name."""

    def add(make):
        SCORERS[name] = make
        return make

    return add


def _numbers(model: Callable[[pd.DataFrame], Sequence[float]], rows: pd.DataFrame) -> np.ndarray:
    found = model(rows)
    kind = getattr(getattr(found, "dtype", None), "kind", "O")
    scores = np.asarray(found, float) if kind in ("f", "i", "u", "b") else np.array([float(x) for x in found], float)
    if scores.shape != (len(rows),):
        raise ValueError(f"{len(scores)} scores for {len(rows)} rows")
    return scores


def _alike(rows: pd.DataFrame) -> np.ndarray:
    """The places of the rows in the order of their values; as they are if the values have no order."""
    try:
        return np.lexsort([rows[c].to_numpy() for c in reversed(rows.columns)])
    except (TypeError, ValueError):
        return np.arange(len(rows))


def _halved(model: Callable[[pd.DataFrame], Sequence[float]], rows: pd.DataFrame, at: np.ndarray, scores: np.ndarray, errors: np.ndarray, first: bool = False) -> None:
    """Fills ``scores`` and ``errors`` at the places of the rows."""
    try:
        scores[at] = _numbers(model, rows)
    except Exception as e:  # whatever a foreign model raises belongs to its rows
        if len(rows) == 1:
            errors[at[0]] = f"{type(e).__name__}: {e}"
            return
        if first:
            order = _alike(rows)
            rows, at = rows.iloc[order], at[order]
        half = len(rows) // 2
        _halved(model, rows.iloc[:half], at[:half], scores, errors)
        _halved(model, rows.iloc[half:], at[half:], scores, errors)


def _columns(model: Callable[[pd.DataFrame], Sequence[float]], rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The scores and the errors of ``judged``."""
    scores, errors = np.zeros(len(rows)), np.full(len(rows), None, object)
    _halved(model, rows, np.arange(len(rows)), scores, errors, True)
    return scores, errors


def judged(model: Callable[[pd.DataFrame], Sequence[float]], rows: pd.DataFrame) -> list[tuple[float, str | None]]:
    """(score, error) of each row. A batch that fails is halved until the rows it fails on are alone; they get 0.

    Before, its rows are put in the order of their values: rows that a model fails on are often alike, and such a run of
    them takes far fewer calls than as many rows anywhere.
    """
    scores, errors = _columns(model, rows)
    return list(zip(scores.tolist(), errors.tolist(), strict=True))


def batches_of(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows in the same order, ``size`` at a time, whatever the sizes of the frames; only the last batch is shorter."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        while len(frame):
            part = frame.iloc[: size - n]
            frame = frame.iloc[len(part) :]
            held.append(part)
            n += len(part)
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def score_external(df: DataFrame, make: str | Callable[[], Callable[[pd.DataFrame], Sequence[float]]], inputs: Sequence[str], size: int = 1000) -> DataFrame:
    """``df`` with ``score`` and ``error``; the model sees ``inputs``, ``size`` rows at a time, and is made once a task.

    A row's score must not hang on its batch. Rows that the model fails on have the score 0 and its message. ``make``: a
    registered name or a function.
    """
    make = SCORERS[make] if isinstance(make, str) else make
    schema = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches_of(frames, size):
            scores, errors = _columns(model, rows[list(inputs)])
            yield rows.assign(score=scores, error=errors)

    return df.mapInPandas(run, schema)
