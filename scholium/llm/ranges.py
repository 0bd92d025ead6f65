"""Tables dealt in order of id into parts of about equal size, however often an id repeats."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts at most: their borders lie on the driver and go to every task. Beyond that parts grow.
MOST_PARTS = 20_000
_PLACES = 1 << 31


def place(text_col: str = "text") -> Column:
    """Where a row stands among those of its id: by a hash of its text. Rows alike in both are equal anyway."""
    return F.pmod(F.xxhash64(text_col), F.lit(_PLACES)).cast("int")


@dataclass
class Ranges:
    """Borders between parts, in order; an id that fills several parts is there as often, and its rows are dealt by place."""

    cuts: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.cuts) + 1

    def part(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.cuts, keys, "left"), np.searchsorted(self.cuts, keys, "right")
        within = (places.astype(np.int64) * (high - low)) // _PLACES
        return (low + np.where(high > low, 1 + within, 0)).astype(np.int32)


def ranges(rows: DataFrame, key: str, text_col: str, part_bytes: int, most_parts: int = MOST_PARTS) -> Ranges:
    """Ranges of ``key`` (long, without nulls) that hold about ``part_bytes`` of text each, if all texts are alike; only keys and lengths are read."""
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(most_parts, max(1, -(-int(size) // part_bytes)))
    cuts = rows.approxQuantile(key, [i / parts for i in range(1, parts)], min(0.001, 0.1 / parts)) if parts > 1 else []
    return Ranges(np.sort(np.array(cuts, np.float64).astype(np.int64)))
