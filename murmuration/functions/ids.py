"""64-bit ids of names: MurmurHash64A, then the absolute value."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Send this module's functions to executors by value, so that they work where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Stored ids depend on them.
MULTIPLIER = 0xC6A4A7935BD1E995
SHIFT = 47
SEED = 0xADC83B19


def _scramble(values: np.ndarray) -> np.ndarray:
    return values ^ (values >> np.uint64(SHIFT))


def murmur64(encoded: list[bytes], seed: int = SEED) -> np.ndarray:
    """Signed 64-bit hashes; all names of one length are hashed together, eight bytes of each at a time."""
    multiplier = np.uint64(MULTIPLIER)
    lengths = np.fromiter((len(name) for name in encoded), dtype=np.int64, count=len(encoded))
    hashes = np.empty(len(encoded), dtype=np.uint64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        width = -(-int(length) // 8) * 8
        padded = b"".join(encoded[row].ljust(width, b"\0") for row in rows)
        words = np.array(np.frombuffer(padded, dtype="<u8") if width else [], dtype=np.uint64)
        words = words.reshape(len(rows), width // 8)
        start = (seed ^ (int(length) * MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF
        state = np.full(len(rows), start, dtype=np.uint64)
        for column in range(width // 8):
            word = words[:, column]
            if column < length // 8:
                word = _scramble(word * multiplier) * multiplier
            state = (state ^ word) * multiplier
        hashes[rows] = _scramble(_scramble(state) * multiplier)
    return hashes.view(np.int64)


@F.pandas_udf(LongType())
def name_id(names: pd.Series) -> pd.Series:
    """Id of a name. Arrow batches, each distinct name of a batch hashed once; no shuffle is needed."""
    codes, distinct = pd.factorize(names)
    ids = pd.Series(np.abs(murmur64([name.encode("utf-8") for name in distinct])), dtype="Int64")
    return ids.reindex(codes).set_axis(names.index)
