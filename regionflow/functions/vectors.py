"""Array columns: greedy choice, learning targets, batch scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow.functions.scalar import clip_q


def argmax(q: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(q, F.array_max(q)) - 1).cast("int")


def td_target(
    q: Column,
    a: Column,
    r: Column,
    done: Column,
    q_next: Column,
    q_next_target: Column,
    gamma: float = 0.99,
    clip: float = 10.0,
) -> Column:
    """q with entry `a` replaced by the clipped one-step target.

    The next action is chosen on `q_next` and valued on `q_next_target`.
    """
    ahead = F.element_at(q_next_target, argmax(q_next) + 1)
    target = clip_q(F.when(done, r).otherwise(r + F.lit(gamma) * ahead), clip)
    return F.transform(q, lambda x, k: F.when(k == a, target).otherwise(x))


def score_dense(
    features: Column,
    weights: list[tuple[np.ndarray, np.ndarray]],
    clamp: float | None = None,
) -> Column:
    """Scores of feature rows under fixed layers (W, b); ReLU between layers.

    One matrix product per Arrow batch and layer. The layers travel with the
    function, so they must be model-sized, never data-sized. A null row has null
    scores; a row of another length than the first layer's fails the job.
    """
    layers = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in weights]

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
                continue
            known = [row for row in batch if row is not None]
            width = layers[0][0].shape[1]
            if any(len(row) != width for row in known):
                raise ValueError(f"a feature row does not have {width} values")
            x = np.array(known, dtype=float).reshape(len(known), width)
            for n, (w, b) in enumerate(layers):
                x = x @ w.T + b
                if n < len(layers) - 1:
                    x = np.maximum(x, 0.0)
            if clamp is not None:
                x = np.clip(x, -clamp, clamp)
            scores = iter(x)
            yield pd.Series([None if row is None else next(scores) for row in batch], dtype=object)

    return score(features)
