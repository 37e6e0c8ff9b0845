"""Order-dependent kernels on one group at a time, run through Arrow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .curves import dtw_distances


def dtw_distance(x: np.ndarray, y: np.ndarray, window: int = 20) -> float:
    """Warping distance of two series of numbers or curves of points."""
    x, y = (np.asarray(c, float) for c in (x, y))
    return float(dtw_distances([x[:, None] if x.ndim == 1 else x], [y[:, None] if y.ndim == 1 else y], window)[0])


def greedy_sequence(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pos, item): start at the largest row sum, then always the best item not yet taken, the smallest of equal ones.

    Rows are kept as lists of their stored cells (absent ones are 0), so a group takes as much memory as it has cells.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        items = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        cells = pdf.groupby(["i", "j"], as_index=False)["score"].max()
        i, j, s = np.searchsorted(items, cells["i"]), np.searchsorted(items, cells["j"]), cells["score"].to_numpy()
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        begin = np.searchsorted(i, np.arange(len(items) + 1))
        free, first_free = np.ones(len(items), bool), 0
        at, out = int(np.bincount(i, s, len(items)).argmax()), []
        while True:
            out.append(at)
            free[at] = False
            while first_free < len(items) and not free[first_free]:
                first_free += 1
            if first_free == len(items):
                break
            row, val = j[begin[at] : begin[at + 1]], s[begin[at] : begin[at + 1]]
            open_ = free[row]
            best = int(open_.argmax()) if open_.any() else -1
            # Stored cells are in order of score, then item; an absent cell is 0 and may lie before a stored 0 or a negative one.
            if best >= 0 and val[best] > 0:
                at = int(row[best])
            else:
                stored = set(row[open_ & (val < 0)].tolist()) if best >= 0 else set()
                at = next((k for k in range(first_free, len(items)) if free[k] and k not in stored), int(row[best]) if best >= 0 else first_free)
        head = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame({**head, "pos": range(len(out)), "item": items[out]})

    keys = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in by)
    return scores.groupBy(*by).applyInPandas(walk, f"{keys}, pos long, item {scores.schema['i'].dataType.simpleString()}")
