"""Vectors of finite components as integers, floor(1024 x) each, in numpy, batch by batch.

Integers beyond ``LARGEST`` (components beyond 131,072) are taken as ``LARGEST``, so that squared distances of 64 components fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 1024
LARGEST = 1 << 27


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: which rows are lists of finite components only, where each row's components begin, and all of them.

    Row i's integers are those from starts[i] to starts[i + 1]; of null rows there are none, of rows that aren't sound they mean nothing.
    """
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    finite = np.isfinite(values)
    faults = np.concatenate([[0], np.cumsum(~finite)])
    sound = (faults[starts[1:]] == faults[starts[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(np.where(finite, values, 0.0) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return sound, starts, whole
