"""Word shingles of whole texts as sorted 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from murmuration.llm.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

WORDS = 5  # of a shingle
BATCH_BYTES = 1 << 20
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers under which near numbers are far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP))


class Hasher:
    """Tables that turn bytes into word hashes: a byte's number times a power of an odd base, summed over the word."""

    def __init__(self, fold: bool = True) -> None:
        values = numbers(256, 1)
        if fold:
            values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
        self.values = values
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = int(numbers(1, 2)[0]) | 1
        self.factors = numbers(WORDS, 3) | np.uint64(1)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BATCH_BYTES)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, dtype=np.uint64)]))
                                      for base in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text's words begin and the last ones end.

        Texts lie one after the other in one array, so that numpy works on all of them; words never reach over the end
        of a text. They are runs of bytes other than white space, A-Z in lower case if the hasher folds them.
        """
        sizes = np.array([len(text) for text in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        word = ~self.space[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
        after = np.concatenate([word[1:], [False]]) & ~edge[1:]
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        with np.errstate(over="ignore"):
            up, down = self.powers(len(data))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[data] * up)])
            return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, bounds)

    def runs(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of every n consecutive word hashes."""
        size = max(0, len(hashes) - n + 1)
        with np.errstate(over="ignore"):
            up, down = self.powers(len(hashes))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up)])
            return mixed((sums[len(sums) - size:] - sums[:size]) * down[:size])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, a text without words has none."""
        if not any(texts):
            return [np.zeros(0, dtype=np.uint64)] * len(texts)
        hashes, first = self.words(texts)
        with np.errstate(over="ignore"):
            runs = max(0, len(hashes) - WORDS + 1)
            total = np.zeros(runs, dtype=np.uint64)
            for k in range(WORDS):
                total += hashes[k:k + runs] * self.factors[k]
            total = mixed(total)
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= WORDS:
                    out.append(np.unique(total[a:b - WORDS + 1]))
                elif b > a:
                    own = (hashes[a:b] * self.factors[:b - a]).sum() + np.uint64(b - a)
                    out.append(mixed(np.array([own], dtype=np.uint64)))
                else:
                    out.append(np.zeros(0, dtype=np.uint64))
        return out


def shingle_sets(texts: list[str | None]):
    """The sets of the texts in order, computed in runs of about ``BATCH_BYTES``."""
    hasher = kept("shingles", "hasher", Hasher)
    run: list[bytes] = []
    size = 0
    for text in texts:
        run.append((text or "").encode("utf-8", "replace"))
        size += len(run[-1])
        if size >= BATCH_BYTES:
            yield from hasher.sets(run)
            run, size = [], 0
    yield from hasher.sets(run)


def share_used(n: int) -> float:
    """Share of all hashes, the lowest ones, that a set of n is judged by at first: enough to hold more than a fifth of it."""
    return 1.0 if n <= 48 else min(1.0, 0.2 + 4.5 * math.sqrt(0.16 / n) + 1 / n)


def below(hashes: np.ndarray, share: float) -> int:
    """How many of the sorted hashes lie below that share of the range."""
    return len(hashes) if share >= 1 else int(np.searchsorted(hashes, np.uint64(int(share * 2.0 ** 64)), "left"))


def emitted(hashes: np.ndarray) -> int:
    """How many of the lowest hashes are looked up by sets of any size that can be linked with this one."""
    return below(hashes, share_used(math.ceil(0.8 * len(hashes))))


def list_array(arrays: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
