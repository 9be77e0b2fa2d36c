"""Harmonic packing of token sequences: lengths in reciprocal-capacity classes, a fixed number of pieces per sequence."""

from __future__ import annotations

import bisect
import gc
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from murmuration.llm.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

CAPACITY = 1024
SLACK = CAPACITY // 32  # padding that a full sequence may have
END_ID = 0
KNOWN_BYTES, KNOWN_REST_BYTES = 8 << 20, 2 << 20  # what a worker remembers of words and of what stands behind them
SLICE_BYTES, TOGETHER = 2 << 20, 4096  # of texts that are looked up together, and unknown words that are encoded as one text
SEQUENCE_BITS = 33  # sequences of one task are numbered in the low bits
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
# White space at the ends of a chunk, or no chunk at all: there a space may belong to another token of the byte-level pattern.
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGES = f"^$|^[{_BLANK}]|[{_BLANK}]$"
# The pattern always ends a token between a letter and an ASCII character of another kind; of other characters none is taken as known.
_PARTS = r"(?s)^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ]+)(?P<rest>[\x00-@\[-`{-\x7f].*)$"
SPACE = "\u0120"  # how a byte-level vocabulary writes a space


def strings(words: pa.Array) -> list[str]:
    """``to_pylist`` of words without nulls, ten times as fast."""
    return words.to_numpy(zero_copy_only=False).tolist()


def gathered(ids: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``index`` of those that lie in ``ids`` one behind the other, in the same form."""
    own = lengths[index]
    total = int(own.sum())
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(lengths) - lengths)[index] - (np.cumsum(own) - own)).astype(kind), own)
    at += np.arange(total, dtype=kind)
    return ids[at], own


class Known:
    """Ids of the strings asked for last, some ``limit`` bytes of them; it only saves time."""

    def __init__(self, limit: int) -> None:
        self.limit, self.calls = limit, 0
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, dtype="<u4")
        self.lengths, self.asked = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def find(self, words: pa.Array, compute) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different ``words``, one behind the other, and their lengths; ``compute`` gives those of a list of strings."""
        self.calls += 1
        at = pc.index_in(words, value_set=self.words.cast(words.type)).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        if new.any():
            unknown = words.filter(pa.array(new))
            ids, lengths = compute(strings(unknown))
            at[new] = len(self.words) + np.arange(len(unknown))
            self.words = pa.concat_arrays([self.words.cast(words.type), unknown])
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
            self.asked = np.concatenate([self.asked, np.zeros(len(unknown), dtype=np.int64)])
        self.asked[at] = self.calls
        found = gathered(self.ids, self.lengths, at)
        self._make_room()
        return found

    def _make_room(self) -> None:
        """Above the limit the half asked for last is left."""
        size = pc.binary_length(self.words).to_numpy().astype(np.int64) + 4 * self.lengths + 24
        if size.sum() > self.limit:
            last = np.argsort(-self.asked, kind="stable")
            left = np.sort(last[np.cumsum(size[last]) <= self.limit // 2])
            self.words, self.asked = self.words.take(pa.array(left)), self.asked[left]
            self.ids, self.lengths = gathered(self.ids, self.lengths, left)


class Encoder:
    """Ids of a byte-level tokenizer file, with those of recent chunks."""

    def __init__(self, path: str, special_as_text: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(1 + max(vocabulary.values()), dtype=bool)  # ids that begin with a space
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.words, self.rests = Known(KNOWN_BYTES), Known(KNOWN_REST_BYTES)
        cuts = str(self.tokenizer.pre_tokenizer)
        by_pattern = cuts.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cuts
        self.by_pattern = by_pattern and self.tokenizer.normalizer is None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _encode_apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(texts)
        return np.concatenate([*found, np.zeros(0, dtype="<u4")]), np.array([len(own) for own in found], dtype=np.int64)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each after its space: thousands are encoded as one text, which is parted where ids begin with a space."""
        if len(chunks) > TOGETHER:
            parts = [self._encode_chunks(chunks[at:at + TOGETHER]) for at in range(0, len(chunks), TOGETHER)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([lengths for _, lengths in parts])
        ids = self.encode([" " + " ".join(chunks)])[0]
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(chunks):  # not a byte-level vocabulary
            return self._encode_apart([" " + chunk for chunk in chunks])
        return ids, np.diff(starts, append=len(ids))

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, each after its space. A word is looked up apart from what stands behind it, so it is the
        same with any marks."""
        if not self.by_pattern:
            return self.words.find(chunks, self._encode_chunks)
        parts = pc.extract_regex(chunks, _PARTS)
        words = pc.coalesce(pc.struct_field(parts, "word"), chunks).dictionary_encode()
        rests = pc.struct_field(parts, "rest").fill_null("").dictionary_encode()
        ids, lengths = self.words.find(words.dictionary, self._encode_chunks)
        rest_ids, rest_lengths = self.rests.find(rests.dictionary, self._encode_apart)
        index = np.column_stack([words.indices.to_numpy(), rests.indices.to_numpy() + len(lengths)]).ravel()
        ids, lengths = gathered(np.concatenate([ids, rest_ids]), np.concatenate([lengths, rest_lengths]), index)
        return ids, lengths.reshape(-1, 2).sum(axis=1)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts without nulls. A token never extends over a single space between other characters, so such texts
        are cut before their spaces and each different chunk is encoded once; others, and those with an added token, are
        encoded whole. A chunk with white space behind it (``odd``), the last of its text, is encoded by itself.
        """
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(words, _EDGES).to_numpy(zero_copy_only=False)
        if odd.any():
            before, behind = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
            edges = strings(words.filter(pa.array(odd)))
            before[odd] = [not word or word[0].isspace() for word in edges]
            behind[odd] = [not word or word[-1].isspace() for word in edges]
            at = np.flatnonzero(odd[codes])
            text, word = owner[at], codes[at]
            whole[text[before[word] & (at != bounds[text]) | behind[word] & (at != bounds[text + 1] - 1)]] = True
        firsts = strings(words.take(pa.array(codes[bounds[:-1]])))
        for i in np.flatnonzero(whole).tolist():
            firsts[i] = texts[i].as_py()
        cut = ~whole[owner]
        cut[bounds[:-1]] = False  # first chunks have no space
        codes = codes[cut]
        used = np.zeros(len(words), dtype=bool)
        used[codes] = True
        odd &= used
        plain = used & ~odd
        pool, sizes = self._chunk_ids(words.filter(pa.array(plain)))
        place = np.zeros(len(words), dtype=np.int64)
        place[plain] = np.arange(len(sizes))
        if odd.any():
            apart, apart_sizes = self._encode_apart([" " + word for word in strings(words.filter(pa.array(odd)))])
            place[odd] = len(sizes) + np.arange(len(apart_sizes))
            pool, sizes = np.concatenate([pool, apart]), np.concatenate([sizes, apart_sizes])
        ids, own = gathered(pool, sizes, place[codes])
        ends = np.concatenate([[0], np.cumsum(own)])
        parts = ends[np.cumsum(np.bincount(owner[cut], minlength=len(texts)))].tolist()
        return [np.concatenate([first, ids[a:b]]) for first, a, b in zip(self.encode(firsts), [0, *parts], parts)]


def encoded_texts(path: str, texts: list[str | None] | pa.Array, special_as_text: bool = True) -> list[np.ndarray]:
    """Token ids of whole texts by the file, a null being empty; strings of added tokens are ordinary text if ``special_as_text``."""
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
    owner = f"tokenizer {path} {special_as_text}"
    encoder = kept(owner, "encoder", lambda: Encoder(path, special_as_text))
    collects = gc.isenabled()
    gc.disable()  # millions of strings and no cycles: looking for some costs a sixth of the time
    try:
        return encoder.ids(texts)
    finally:
        if collects:
            gc.enable()


def slices(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows of ``batch(doc_id, text)`` in parts of some ``SLICE_BYTES`` of text, or one longer text more."""
    before = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    bounds = [0, *(1 + np.flatnonzero(np.diff(before))).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:]) if a < b]


def cut_lengths(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """Pieces (length, class) of a document: whole sequences, then reciprocal parts of a sequence.

    Class k holds k pieces per sequence. A rest that k times nearly fills a sequence is a piece of class k; of any other
    the exact (k + 1)-th part of a sequence is cut off. So every full sequence has at most ``slack`` ids of padding.
    """
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest > slack:
            k, taken = k + 1, capacity // (k + 1)
        else:
            taken = rest
        pieces.append((taken, k))
        rest -= taken
    return pieces


class Packer:
    """Sequences of one worker: those of a class are filled by count, and what is left at the end by best fit."""

    def __init__(self, part: int) -> None:
        self.next = part << SEQUENCE_BITS
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        for length, k in cut_lengths(total):
            own = self.open.setdefault(k, [])
            own.append((doc_id, start, length, zlib.crc32(ids[start:start + length]), total))
            if len(own) == k:
                self._close(self.open.pop(k))
            start += length

    def finish(self) -> None:
        """Classes left open hold fewer than k pieces each, however many documents there were."""
        left = sorted((piece for pieces in self.open.values() for piece in pieces), key=lambda p: -p[2])
        room: list[tuple[int, int]] = []
        bins: list[list[tuple]] = []
        for piece in left:
            at = bisect.bisect_left(room, (piece[2], -1))
            if at == len(room):
                bins.append([])
                free, place = CAPACITY, len(bins) - 1
            else:
                free, place = room.pop(at)
            bins[place].append(piece)
            bisect.insort(room, (free - piece[2], place))
        self.open = {}
        for pieces in bins:
            self._close(pieces)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * 7
        self.done = []
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of every row of ``docs(doc_id, text)``: ``SCHEMA``.

    A document is the ids that the tokenizer file gives its text, strings of special tokens included (``add_special_tokens``
    adds none), and ``END_ID``. Workers pack their partitions independently and without a shuffle;
    ``sequence_id`` is made of the partition's number and a counter, so a repeated task makes the same sequences. A worker
    holds at most k - 1 pieces (numbers, not ids) of each class k <= ``CAPACITY``. Sequences are padded to ``CAPACITY``, except where the
    length is a power of two.

    Nulls: a null text is empty and still has its ``END_ID``; a null ``doc_id`` stays null. Repeated rows are packed each.
    No rows give no rows.
    """

    def run(batches):
        packer = Packer(TaskContext.get().partitionId())
        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded_texts(tokenizer_path, part.column(1), False)):
                    packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
