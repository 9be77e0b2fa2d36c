"""Benchmark contamination by pigeonhole edit matching: exact hits of item pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import Tables
from murmuration.llm.worker import kept, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
BLOCK_CHARS = 1 << 20  # of items that a worker holds at once
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Pattern:
    """A test item in normal form with its error budget and its pieces as (offset, piece)."""

    item_id: int
    text: str
    budget: int
    pieces: tuple[tuple[int, str], ...]


def normal_form(text: str) -> str:
    """Lower case, with every run of white space as one space and none at the ends."""
    return _SPACE.sub(" ", text).strip().lower()


def pattern_of(item_id: int, text: str, error_rate: float) -> Pattern | None:
    """``budget + 1`` pieces of nearly equal length: ``budget`` edits leave one of them untouched (pigeonhole)."""
    text = normal_form(text)
    if not text:
        return None
    budget = min(int(len(text) * error_rate), len(text) - 1)
    bounds = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return Pattern(item_id, text, budget, tuple((a, text[a:b]) for a, b in zip(bounds, bounds[1:])))


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Myers' algorithm: the least edit distance of the pattern to a substring of ``text``, and where the first such ends."""
    ones, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = ones, 0, length
    best, end = length, 0
    for i, char in enumerate(text):
        match = masks.get(char, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = down | (ones & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & ones  # a match may begin anywhere in the text
        minus = (minus << 1) & ones
        up = minus | (ones & ~(diagonal | plus))
        down = plus & diagonal
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """All pieces of all items in one automaton."""

    def __init__(self, patterns: list[Pattern]) -> None:
        import ahocorasick

        self.patterns = patterns
        self.masks = [char_masks(p.text) for p in patterns]
        self.back = [char_masks(p.text[::-1]) for p in patterns]
        uses: dict[str, list[tuple[int, int]]] = {}
        for number, pattern in enumerate(patterns):
            for offset, piece in pattern.pieces:
                uses.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in uses.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the nearest substring for every item within its budget; offsets are in the normal form.

        Each hit of a piece says where the item would lie, give or take the budget. Windows that touch are verified as one, so
        hits of many pieces of a passage, or of a frequent piece, cost one pass over the text.
        """
        if not self.patterns:
            return []
        text = normal_form(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(text):
            begin = last + 1 - length
            for number, offset in where:
                pattern = self.patterns[number]
                low = max(0, begin - offset - pattern.budget)
                high = begin - offset + len(pattern.text) + pattern.budget
                own = windows.setdefault(number, [])
                if own and low <= own[-1][1]:
                    own[-1][0] = min(low, own[-1][0])
                    own[-1][1] = max(high, own[-1][1])
                else:
                    own.append([low, high])
        found = []
        for number, spans in windows.items():
            pattern, best = self.patterns[number], None
            for low, high in spans:
                part = text[low:high]
                at = part.find(pattern.text)
                if at >= 0:
                    near = (0, low + at + len(pattern.text))
                else:
                    distance, end = best_match(self.masks[number], len(pattern.text), part)
                    near = (distance, low + end)
                if near[0] <= pattern.budget and (best is None or near < best):
                    best = near
            if best is not None:
                distance, end = best
                if distance == 0:
                    start = end - len(pattern.text)
                else:  # the start is where the reversed pattern ends in the reversed text before the end
                    before = text[max(0, end - len(pattern.text) - distance):end][::-1]
                    start = end - prefix_end(self.back[number], len(pattern.text), before, distance)
                found.append((pattern.item_id, distance, start, end))
        return sorted(found)


def prefix_end(masks: dict[str, int], length: int, text: str, distance: int) -> int:
    """Length of the shortest prefix of ``text`` at ``distance`` from the whole pattern."""
    ones, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = ones, 0, length
    for i, char in enumerate(text):
        match = masks.get(char, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = down | (ones & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = ((plus << 1) | 1) & ones  # the match begins at the first character
        minus = (minus << 1) & ones
        up = minus | (ones & ~(diagonal | plus))
        down = plus & diagonal
        if score == distance:
            return i + 1
    return len(text)


def _blocks(benchmark: DataFrame, error_rate: float):
    """The items' patterns, in blocks of about ``BLOCK_CHARS`` characters; items of one id are in one block."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), "text").where("text is not null").distinct()
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # bounded by the block
        found = {(p.item_id, p.text): p for p in (pattern_of(r["item_id"], r["text"], error_rate) for r in rows) if p}
        if found:
            yield sorted(found.values(), key=lambda p: (str(p.item_id), p.text))


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08) -> DataFrame:
    """``SCHEMA``: one row per row of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` found in it.

    An item is found where some substring of the whole text, both in normal form, is within ``error_rate`` times the
    item's length of it in edits. Rows give the nearest such substring (the first of equals) and its offsets in the
    normal form. Items are broadcast in blocks of bounded size, one pass over the documents per block.

    Nulls: null and blank items match nothing, null texts have no matches, and a null ``doc_id`` stays null. Items that
    repeat an id and a normal form count once; different texts under one id are found each. Repeated documents are
    reported each. Empty tables give no rows.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    found = None
    for number, patterns in enumerate(_blocks(benchmark, error_rate)):
        opened, name = shared(docs.sparkSession, patterns)
        part = tables.put(f"block{number}", rows.mapInArrow(_search(opened, name), SCHEMA))
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def _search(opened, name: str):
    def search(batches):
        matcher = kept(name, "matcher", lambda: Matcher(opened()))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [(doc_id, *match) for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                       for match in (matcher.matches(text) if text else ())]
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)],
                                                 names=[field.split()[0] for field in SCHEMA.split(", ")])

    return search


def _filter(opened, name: str, at: int):
    def search(batches):
        matcher = kept(name, "matcher", lambda: Matcher(opened()))
        for batch in batches:
            clean = [not (text and matcher.matches(text)) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, type=pa.bool_()))

    return search


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with all their columns; a null ``doc_id`` is kept if clean.

    The text is searched where the row is: no row is shuffled and nothing is joined. What one block of items leaves is
    stored, and the next block searches that.
    """
    tables, at = Tables(docs.sparkSession), docs.columns.index("text")
    for number, patterns in enumerate(_blocks(benchmark, error_rate)):
        if number:
            docs = tables.put(f"clean{number}", docs)
            tables.drop(f"clean{number - 1}")
        opened, name = shared(docs.sparkSession, patterns)
        docs = docs.mapInArrow(_filter(opened, name, at), docs.schema)
    return docs
