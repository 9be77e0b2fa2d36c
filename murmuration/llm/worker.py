"""State that a Python worker keeps from one task to the next. It only saves time: results never depend on it."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def kept(owner: str, what: str, make):
    """The worker's object ``what`` of ``owner``, made at first use; objects of other owners are let go first."""
    store = sys.modules.setdefault("_murmuration_worker", ModuleType("_murmuration_worker")).__dict__
    if store.get("owner") != owner:
        if "owner" in store:
            store.clear()
            _give_back()
        store["owner"] = owner
    key = f"kept {what}"
    if key not in store:
        store[key] = make()
    return store[key]


def _give_back() -> None:
    """Return freed memory to the system, which the executor shares with the worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared(spark, thing):
    """A broadcast of ``thing`` by value: a function that gives a worker's copy, and the owner's name for what goes with it."""
    data = cloudpickle.dumps(thing)
    name = hashlib.sha256(data).hexdigest()
    sent = spark.sparkContext.broadcast(data)
    return (lambda: kept(name, "shared", lambda: cloudpickle.loads(sent.value))), name


ENTRY_BYTES = 250  # of an entry besides its key's characters, with its place in the dictionary


class Recent:
    """Values of the keys seen last: what two generations of ``limit / 2`` bytes hold, and what the last call asked for."""

    def __init__(self, limit: int) -> None:
        self.limit, self.used, self.new, self.old = limit // 2, 0, {}, {}

    def make_room(self) -> None:
        """Start a new generation if this one is full."""
        if self.used > self.limit:
            self.old, self.new, self.used = self.new, {}, 0

    def fill(self, keys, compute) -> dict:
        """A dictionary that has all of ``keys``; ``compute`` maps a list of unknown keys to their values."""
        if set(keys).difference(self.new):
            self.make_room()
        return self.add(set(keys).difference(self.new), compute)

    def add(self, missing: set, compute) -> dict:
        """The dictionary with ``missing`` keys added; it has what it had since ``make_room``."""
        if missing:
            found = {key: self.old[key] for key in missing & self.old.keys()}
            unknown = list(missing - found.keys())
            found.update(zip(unknown, compute(unknown)))
            self.used += ENTRY_BYTES * len(found) + sum(map(len, found))
            self.new.update(found)
        return self.new
