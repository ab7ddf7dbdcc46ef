"""Learning progress per label as a stream with its own state: count, ranges, last accuracies, stop mark.

Corrections are first folded per Arrow batch and label by the tasks that read them, so a label that fills the stream sends
one row per batch to its state, not one per correction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.corrections import corrections_v1

SIZES = ("x", "y", "width", "height")
RANGES = [f"{c}_{end}" for c in SIZES for end in ("min", "max")]
PART = "label string, n bigint, " + ", ".join(f"{c} double" for c in RANGES)
STATE = "n bigint, stopped_at bigint, recent array<double>, " + ", ".join(f"{c} double" for c in RANGES)
OUT = "label string, n bigint, accuracy double, recent_low double, recent_high double, stopped_at bigint, active boolean, " + ", ".join(f"{c} double" for c in RANGES)


def folded(batches):
    """Count and ranges per label of each Arrow batch."""
    import pandas as pd

    for batch in batches:
        by = batch.groupby("label", dropna=False)
        parts = {"n": by.size(), **{f"{c}_{end}": by[c].agg(end) for c in SIZES for end in ("min", "max")}}
        yield pd.DataFrame(parts).reset_index()[["label", "n", *RANGES]]


class Progress(StatefulProcessor):
    """State of one label. Learning stops at ``enough`` accuracy, or when the last ``width`` values differ by less than ``gain``.

    A label that has stopped stays stopped; its count and ranges go on.
    """

    def __init__(self, step: float, enough: float, width: int, gain: float):
        self.step, self.enough, self.width, self.gain = step, enough, width, gain

    def init(self, handle) -> None:
        self.state = handle.getValueState("progress", STATE)

    def accuracies(self, first: int, last: int):
        import numpy as np

        return np.minimum(0.5 + np.arange(first, last + 1) * self.step, 0.99)

    def stop_in(self, recent: list, first: int, new):
        """Number of the first correction from ``first`` on after which learning stops, or None."""
        import numpy as np

        hits = new >= self.enough
        seen = np.concatenate([recent[-(self.width - 1):], new]) if self.width > 1 else new
        if len(seen) >= self.width:
            frames = np.lib.stride_tricks.sliding_window_view(seen, self.width)
            flat = frames.max(1) - frames.min(1) < self.gain
            hits[len(new) - len(flat):] |= flat
        at = np.flatnonzero(hits)
        return int(first + at[0]) if len(at) else None

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        old = self.state.get() if self.state.exists() else None
        n, stopped, recent = (old[0], old[1], list(old[2])) if old else (0, None, [])
        ends = dict(zip(RANGES, old[3:])) if old else {}
        for part in rows:
            for c in RANGES:
                pick = min if c.endswith("min") else max
                value = getattr(part[c], "min" if c.endswith("min") else "max")()
                ends[c] = float(value if c not in ends else pick(ends[c], value))
            new = self.accuracies(n + 1, n + int(part["n"].sum()))
            if stopped is None:
                stopped = self.stop_in(recent, n + 1, new)
            recent = [float(a) for a in [*recent, *new[-self.width:]][-self.width:]]
            n += len(new)
        self.state.update((n, stopped, recent, *[ends[c] for c in RANGES]))
        row = {"label": key[0], "n": n, "accuracy": recent[-1], "recent_low": min(recent), "recent_high": max(recent), "stopped_at": stopped, "active": stopped is None, **ends}
        yield pd.DataFrame([row]).astype({"stopped_at": "Int64"})

    def close(self) -> None:
        pass


def learning(boxes: DataFrame, step: float = 0.01, enough: float = 0.95, width: int = 50, gain: float = 0.02) -> DataFrame:
    """Streaming table of labels that a batch has changed: count, accuracy, its range over the last ``width`` corrections, the
    count at which learning stopped (null: goes on), and the ranges of the boxes. Needs the RocksDB state store and update mode.
    """
    parts = corrections_v1(boxes).select("label", *SIZES).mapInPandas(folded, PART)
    return parts.groupBy("label").transformWithStateInPandas(Progress(step, enough, width, gain), OUT, "Update", "None")
