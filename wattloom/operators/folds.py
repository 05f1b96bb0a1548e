"""Sequential state over an ordered series, streamed through the task instead of gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Arrays = dict[str, np.ndarray]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object],
                 step: Callable[[object, Arrays], Arrays], schema: str) -> DataFrame:
    """Run ``step(state, columns)`` over each series in order.

    The rows arrive in Arrow batches; ``state`` is what ``start()`` made for the series and is changed in
    place, so a series of any length needs the memory of one batch only. Series run in parallel. The
    columns of a piece are array views and the results of a batch are put together once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            cols = {c: batch[c].to_numpy() for c in batch.columns}
            change = np.zeros(len(batch), dtype=bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(cols[k][a] for k in keys)
                if state is None or key != current:
                    current, state = key, start()
                parts.append(step(state, {c: v[a:b] for c, v in cols.items()}))
            yield pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class LastEmitted:
    """State of a cooldown: when the series last let an event through."""

    def __init__(self) -> None:
        self.at: int | None = None


def emit_with_cooldown(state: LastEmitted, times: np.ndarray, cooldown: int) -> np.ndarray:
    """Which of the ascending ``times`` pass, measured from the last one that passed."""
    keep = np.zeros(len(times), dtype=bool)
    i = 0 if state.at is None else int(np.searchsorted(times, state.at + cooldown, side="left"))
    while i < len(times):
        keep[i] = True
        state.at = int(times[i])
        i += 1 + int(np.searchsorted(times[i + 1:], state.at + cooldown, side="left"))
    return keep
