"""Substring dedup: documents are streamed through suffix automata of reference shards, and long repeated spans are removed.

1. Every window of ``WINDOW`` words holds the anchor that is its least run of ``GRAM`` words. Anchors that documents of
   different ids have are counted with partial sums; only windows around them can repeat.
2. Those windows' fingerprints say which document has each first. They only route: the runs of windows that a document has
   first, and others repeat, are references; later runs go to the shard of the document that has them first.
3. References are dealt to shards of a bounded number of words. A shard's words go to every task that streams documents
   through it, as many as its stream needs, so a passage that a third of all documents have is no hot group. The task builds the suffix
   automaton, and streams its documents for matching statistics: wherever the longest match reaches ``WINDOW`` words
   and the automaton knows the words from a smaller id, the words are marked. Words are compared, not fingerprints.

Documents that repeat a whole word sequence are one class, for which the least id speaks: all windows of the others are in it.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import Tables
from murmuration.llm.shingles import Hasher, list_array, mixed
from murmuration.llm.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

WINDOW, GRAM = 50, 25
SHARD_WORDS = 40_000  # reference words of a shard, on average; its automaton has at most twice as many states
STREAM_WORDS = 400_000  # words that a task streams through one automaton, on average
_SECOND = np.uint64(0x5851F42D4C957F2D)
_PART = 128  # rows at a time


def _words(column: pa.Array) -> list[list[bytes]]:
    return [(text or b"").split() for text in column.cast(pa.binary()).to_pylist()]  # bytes.split: \x20 and \x09-\x0D


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hasher = kept("repeats", "hasher", lambda: Hasher(fold=False))
    return hasher.words(texts) if any(texts) else (np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    return kept("repeats", "hasher", lambda: Hasher(fold=False)).runs(hashes, n)


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """For every window of ``WINDOW`` word hashes the least hash of its runs of ``GRAM``."""
    least, width, wanted = _runs(hashes, GRAM), 1, WINDOW - GRAM + 1
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0], 2 * width
    rest = wanted - width
    return np.minimum(least[:-rest], least[rest:]) if rest and len(least) > rest else least[:0] if rest else least


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _PART):
            yield batch.slice(at, _PART)


def _sketches(batches):
    """doc_id, cls, mark, n_words, anchors: cls is the digest of the words, mark its first half."""
    for part in _parts(batches):
        texts = [b" ".join(words) for words in _words(part.column(1))]
        hashes, first = _hashed(texts)
        least, bounds = window_anchors(hashes), first.tolist()
        anchors = [np.unique(least[a:max(a, b - WINDOW + 1)]) for a, b in zip(bounds, bounds[1:])]
        digests = [hashlib.sha256(text).digest() for text in texts]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(digests, pa.binary()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
             pa.array([b - a for a, b in zip(bounds, bounds[1:])], pa.int64()), list_array(anchors)],
            names=["doc_id", "cls", "mark", "n_words", "anchors"])


def _candidates(batches):
    """rep, mark, words, places, one, two: a document's words, and the places and fingerprints of its windows with shared anchors."""
    for part in _parts(batches):
        texts = [b" ".join(words) for words in _words(part.column(1))]
        hashes, first = _hashed(texts)
        bounds, least = first.tolist(), window_anchors(hashes)
        one = _runs(hashes, WINDOW)
        with np.errstate(over="ignore"):
            two = _runs(mixed(hashes + _SECOND), WINDOW)
        rows = []
        for i, (text, cls, anchors) in enumerate(zip(texts, part.column(2).to_pylist(), part.column(3))):
            if hashlib.sha256(text).digest() == cls:  # else another text of the id
                a, b = bounds[i], max(bounds[i], bounds[i + 1] - WINDOW + 1)
                places = np.flatnonzero(np.isin(least[a:b], anchors.values.to_numpy().view(np.uint64)))
                rows.append((part.column(0)[i].as_py(), int.from_bytes(cls[:8], "little", signed=True), text, places, one[a:b][places], two[a:b][places]))
        rep, mark, words, places, ones, twos = zip(*rows) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep, pa.int64()), pa.array(mark, pa.int64()), pa.array(words, pa.binary()),
             *[list_array([x.astype(np.uint64) for x in own]) for own in (places, ones, twos)]],
            names=["rep", "mark", "words", "places", "one", "two"])


def _pieces(batches):
    """first, stream, rep, mark, start, size, words: every maximal run of windows with the same first document."""
    for part in _parts(batches):
        rows = []
        for rep, mark, text, runs in zip(*[part.column(i).to_pylist() for i in range(4)]):
            words = text.split(b" ")
            places: dict[int, set[int]] = {}
            for run in runs:
                places.setdefault(run["first"], set()).add(run["place"])
            for first, own in places.items():
                at = np.array(sorted(own))
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    a, b = int(run[0]), int(run[-1]) + WINDOW
                    rows.append((first, rep != first, rep, mark, a, b - a, b" ".join(words[a:b])))
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)],
                                         names=["first", "stream", "rep", "mark", "start", "size", "words"])


class Automaton:
    """Suffix automaton of word runs; a state knows the least document among all occurrences of its words."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [math.inf]
        self.ready = True

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.least.append(math.inf)
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that ``word`` leads to from ``state``, parted if it also stands for longer runs."""
        to = self.next[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes], document: int) -> None:
        last, self.ready = 0, False
        for word in words:
            number = self.numbers.setdefault(word, len(self.numbers))
            if number in self.next[last]:  # an earlier run went this way
                last = self._split(last, number)
            else:
                state, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and number not in self.next[at]:
                    self.next[at][number] = state
                    at = self.link[at]
                if at >= 0:
                    self.link[state] = self._split(at, number)
                last = state
            self.least[last] = min(self.least[last], document)

    def _finish(self) -> None:
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.least[state] < self.least[above]:
                self.least[above] = self.least[state]
        self.ready = True

    def spans(self, words: list[bytes], document: int, threshold: int = WINDOW) -> list[tuple[int, int]]:
        """Maximal spans of words covered by matches of ``threshold`` words that a smaller document has."""
        if not self.ready:
            self._finish()
        steps, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        out: list[list[int]] = []
        for i, number in enumerate(map(self.numbers.get, words)):
            if number is None:
                state = matched = 0
                continue
            while state and number not in steps[state]:
                state = link[state]
                matched = length[state]
            to = steps[state].get(number)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= threshold:
                while length[link[state]] >= threshold:
                    state = link[state]
                matched = threshold  # of the longest match, its last words suffice
                if least[state] < document:
                    a, b = i + 1 - threshold, i + 1
                    if out and a <= out[-1][1]:
                        out[-1][1] = b
                    else:
                        out.append([a, b])
        return [tuple(span) for span in out]


def _matches(batches):
    """rep, mark, start, stop of the spans to be removed; rows come by shard and salt, references first."""
    key, automaton = None, None
    for part in _parts(batches):
        rows = []
        for shard, salt, stream, rep, mark, start, text in zip(*[c.to_pylist() for c in part.columns]):
            if key != (shard, salt):
                key, automaton = (shard, salt), Automaton()
            words = text.split(b" ")
            if stream:
                rows += [(rep, mark, start + a, start + b) for a, b in automaton.spans(words, rep)]
            else:
                automaton.add(words, rep)
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["rep", "mark", "start", "stop"])


def _removed(batches):
    """rep, mark, n_removed, kept: how many words go, and the digest of the others."""
    for part in _parts(batches):
        rows = []
        for rep, mark, text, spans in zip(*[part.column(i).to_pylist() for i in range(4)]):
            words, left, at, gone = text.split(b" "), [], 0, 0
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                left += words[at:max(at, a)]
                gone += max(0, b - max(at, a))
                at = max(at, b)
            rows.append((rep, mark, gone, hashlib.sha256(b" ".join(left + words[at:])).hexdigest()))
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["rep", "mark", "n_removed", "kept"])


def repeated_spans(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of every row of ``docs``, of its class, and of the spans (``rep, mark, start, stop``) to be removed."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    sketch = tables.put("sketch", texts.mapInArrow(
        _sketches, "doc_id long, cls binary, mark long, n_words long, anchors array<long>"))
    rows = tables.put("rows", sketch.drop("anchors"))
    classes = tables.put("classes", rows.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
                         .groupBy("cls").agg(F.min("doc_id").alias("rep")))
    firsts = tables.put("firsts", sketch.join(classes, "cls").where("doc_id = rep").select("cls", "rep", F.explode("anchors").alias("anchor")))
    tables.drop("sketch")
    shared = tables.put("shared", firsts.groupBy("anchor").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
                        .where("a < b").select("anchor"))
    wanted = tables.put("wanted", firsts.join(shared, "anchor").groupBy(F.col("rep").alias("doc_id"), "cls")
                        .agg(F.collect_list("anchor").alias("anchors")))
    tables.drop("firsts", "shared")
    # Merged at every size: what repeats in a large table is no small side either.
    candidates = tables.put("candidates", texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "cls", "anchors").mapInArrow(
        _candidates, "rep long, mark long, words binary, places array<long>, one array<long>, two array<long>"))
    tables.drop("wanted")
    windows = candidates.select("rep", "mark", F.explode(F.arrays_zip("places", "one", "two")).alias("w")).select(
        "rep", "mark", F.col("w.places").alias("place"), F.col("w.one").alias("one"), F.col("w.two").alias("two"))
    origins = tables.put("origins", windows.groupBy("one", "two").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
                         .where("first < last").drop("last"))
    runs = tables.put("runs", windows.join(origins, ["one", "two"]).groupBy("rep", "mark")
                      .agg(F.collect_list(F.struct("first", "place")).alias("runs")))
    tables.drop("origins")
    pieces = tables.put("pieces", candidates.select("rep", "mark", "words").join(runs, ["rep", "mark"]).mapInArrow(
        _pieces, "first long, stream boolean, rep long, mark long, start long, size long, words binary"))
    tables.drop("runs")
    held = pieces.agg(F.sum(F.when(~F.col("stream"), F.col("size"))).alias("n")).first()["n"] or 0
    shards = math.ceil(held / SHARD_WORDS) or 1
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).alias("shard")
    salts = tables.put("salts", pieces.where("stream").groupBy(shard).agg(
        F.ceil(F.sum("size") / STREAM_WORDS).cast("int").alias("salts")))
    dealt = pieces.withColumn("shard", shard).join(salts, "shard")
    columns = ["shard", "salt", "stream", "rep", "mark", "start", "words"]
    dealt = (dealt.where("stream").withColumn("salt", F.pmod(F.xxhash64("rep", "start"), F.col("salts")).cast("int")).select(columns)
             .unionByName(dealt.where("not stream").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(columns)))
    spans = tables.put("spans", dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "stream").mapInArrow(
        _matches, "rep long, mark long, start long, stop long"))
    tables.drop("pieces", "salts")
    gone = spans.groupBy("rep", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    answers = tables.put("removed", candidates.select("rep", "mark", "words").join(gone, ["rep", "mark"]).mapInArrow(
        _removed, "rep long, mark long, n_removed long, kept string"))
    tables.drop("candidates")
    return rows, classes, answers.dropDuplicates(["rep", "mark"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row per row of ``docs(doc_id, text)``.

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A word goes if a window of ``WINDOW`` words covers it
    whose word sequence is also in a document with a smaller id, as the texts were given. ``kept_sha256`` is the digest
    of the words left, joined by single spaces.

    Nulls: a null text has no words; a row with a null ``doc_id`` loses nothing and takes nothing from others. Rows that
    repeat an id and a text get equal answers; texts under one id take nothing from each other. Extra columns are ignored. No
    rows give no rows.
    """
    rows, classes, answers = repeated_spans(docs, Tables(docs.sparkSession))
    known = rows.join(classes, "cls", "left").join(
        answers.withColumnsRenamed({"rep": "doc_id"}), ["doc_id", "mark"], "left")
    later = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))  # a copy of a whole text
    return known.select(
        "doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(later, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("cls")))).alias("kept_sha256"))
