"""Language of mixed texts: script ranges narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.toxicity import held_out, marks
from murmuration.llm.worker import Recent, kept, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{marks()}])*")  # a letter may carry marks: many scripts write vowels so
CACHED_BYTES = 160 << 20  # of words and their scores in a worker

# Main ranges of Unicode scripts; a letter in none of them is of the script "Other".
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF),
    ("Mongolian", 0x1800, 0x18AF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
)
_STARTS = np.array([start for _, start, _ in SCRIPTS])
UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    """``rows`` bounds the labelled rows of each language that the model is fitted on."""

    rows: int = 1500
    smoothing: float = 0.1
    penalty: float = 14.0  # log-odds that a change of language must earn
    unseen_script: float = -30.0  # per word, for a language not written in the word's script
    least_share: float = 0.01  # of a language's words in a script that counts as its own


@dataclass(frozen=True)
class Model:
    shape: Shape
    languages: list[str]
    grams: dict[str, int]
    worth: np.ndarray  # per gram and language: log-probability of its last character after the others
    scripts: list[frozenset[str]]


def script_of(letter: str) -> str:
    code = ord(letter)
    name, _, end = SCRIPTS[max(0, int(np.searchsorted(_STARTS, code, "right")) - 1)]
    return name if code <= end else "Other"


def trigrams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[max(0, i - 2):i + 1] for i in range(1, len(marked))]


def _gram_counts(frames):
    """Per language: how often each trigram and each script occurs; one row per gram and task, not per document."""
    counts: Counter = Counter()
    for frame in frames:
        words: Counter = Counter()
        for language, text in zip(frame["lang"], frame["text"]):
            words.update((language, word) for word in WORD.findall((text or "").lower()))
        for (language, word), n in words.items():
            counts[language, "script", script_of(word[0])] += n
            for gram in trigrams(word):
                counts[language, "gram", gram] += n
    yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["lang", "kind", "gram", "n"])


def fit(docs: DataFrame, shape: Shape = Shape()) -> Model:
    """Fit on at most ``shape.rows`` documents of each language that is not null, by a hash of the id, among rows not held out.

    The counts are added up by Spark; the driver gets one row per language and trigram of the sample.
    """
    labelled = docs.where(~held_out()).where("doc_id is not null and lang is not null").select("doc_id", "lang")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # the label set
    chosen = []
    for language in languages:
        chosen += (labelled.where(F.col("lang") == language).select("doc_id", "lang").distinct()
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(shape.rows).collect())  # bounded by the parameter
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string")
    counts = (docs.where("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
              .groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that repeat an id, one
              .select("lang", "text").mapInPandas(_gram_counts, "lang string, kind string, gram string, n long")
              .groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    scripts = []
    found = counts[counts.kind == "script"]
    for language in languages:
        own = found[found.lang == language].set_index("gram").n
        scripts.append(frozenset(own.index[own >= shape.least_share * own.sum()]))
    grams = counts[counts.kind == "gram"].pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0)
    grams = grams.reindex(columns=languages, fill_value=0).sort_index()
    before = grams.groupby(grams.index.str[:-1]).transform("sum").to_numpy(dtype=np.float64)
    alphabet = max(2, grams.index.str[-1].nunique())
    seen = grams.to_numpy(dtype=np.float64)
    worth = np.log((seen + shape.smoothing) / (before + shape.smoothing * alphabet))
    unknown = np.full((1, len(languages)), np.log(1 / alphabet))  # tells nothing
    return Model(shape, languages, {gram: i for i, gram in enumerate(grams.index)}, np.vstack([worth, unknown]), scripts)


def word_scores(words: list[str], model: Model) -> list[tuple[float, ...]]:
    """Log-probability of each word in each language; languages not written in its script are out of the question.

    Only differences between languages matter, so the best is set to 0. A script of no language tells nothing.
    """
    if not words:
        return []
    none = len(model.grams)
    places, starts = [], []
    for word in words:
        starts.append(len(places))
        places.extend(model.grams.get(gram, none) for gram in trigrams(word))
    sums = np.add.reduceat(model.worth[places], starts, axis=0)
    for i, word in enumerate(words):
        script = script_of(word[0])
        fits = [script in own for own in model.scripts]
        if not any(fits):
            sums[i] = 0.0
        elif not all(fits):
            sums[i, np.logical_not(fits)] = sums[i].max() + model.shape.unseen_script
    sums -= sums.max(axis=1, keepdims=True)
    return list(map(tuple, sums.tolist()))


def _one_language(scores: np.ndarray, penalty: float) -> int | None:
    """The language of the whole text, if no path with changes can be better.

    No run of words gains more than half a penalty over the best single language; a path with m other runs has at least
    m - 1 changes, m if the best language occurs in it, so it cannot make up for them.
    """
    totals = scores.sum(axis=0)
    best = int(np.argmax(totals))
    gains = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gains, axis=0), 0.0)
    lowest = np.vstack([np.zeros((1, scores.shape[1])), lowest[:-1]])
    return best if (gains - lowest).max() <= penalty / 2 else None


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Language of every word on the best path; staying wins ties, then the first language."""
    n, width = scores.shape
    back = np.empty((n, width), dtype=np.int16)
    rows = scores.tolist()
    value, every = [0.0] * width, range(width)
    for i in range(n):
        top = max(value)
        best = value.index(top)
        moved = top - penalty
        row, step = rows[i], back[i]
        for j in every:
            if value[j] >= moved or i == 0:
                step[j] = j
                value[j] += row[j]
            else:
                step[j] = best
                value[j] = moved + row[j]
    path = np.empty(n, dtype=np.int16)
    state = value.index(max(value))
    for i in range(n - 1, -1, -1):
        path[i] = state
        state = back[i, state]
    return path


def spans(text: str | None, model: Model, recent: Recent) -> list[tuple[str, int]]:
    """(language, letters) of the text's spans in order; a span ends where the language of the words changes."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return []
    if not model.languages:
        return [(UNKNOWN, sum(map(len, words)))]
    try:
        scores = list(map(recent.new.__getitem__, words))
    except KeyError:
        scores = list(map(recent.fill(words, lambda new: word_scores(new, model)).__getitem__, words))
    scores = np.array(scores)
    whole = _one_language(scores, model.shape.penalty)
    if whole is not None:
        return [(model.languages[whole], sum(map(len, words)))]
    path = viterbi(scores, model.shape.penalty)
    ends = np.flatnonzero(np.append(path[1:] != path[:-1], True))
    letters = np.cumsum([len(word) for word in words])[ends]
    return [(model.languages[path[end]], int(n)) for end, n in zip(ends, np.diff(letters, prepend=0))]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, lang_spans`` for every row of ``docs(doc_id, text)``, from its whole text.

    ``lang_spans`` are the spans as (language, letters); ``lang_pred`` is the language with the most letters, the first by
    name of equals, and ``score`` its share of all letters. A null text, or one without letters, is ``und`` with score 0
    and no spans. A text in scripts that no language is written in gets the first language, as nothing speaks against
    it. Null ids stay null, repeated rows are answered each, and no rows give no rows.
    """
    opened, name = shared(docs.sparkSession, model)  # of the size of the sample's trigrams

    @F.pandas_udf("lang_pred string, score double, lang_spans array<struct<lang:string,letters:long>>")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        model = opened()
        recent = kept(name, "words", lambda: Recent(CACHED_BYTES))
        rows = []
        for text in texts:
            found = spans(text, model, recent)
            letters: Counter = Counter()
            for language, n in found:
                letters[language] += n
            best = min(letters, key=lambda name: (-letters[name], name), default=UNKNOWN)
            share = letters[best] / sum(letters.values()) if letters else 0.0
            rows.append((best, share, [{"lang": a, "letters": n} for a, n in found]))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "lang_spans"])

    return docs.select("doc_id", labelled(F.col("text")).alias("l")).select("doc_id", "l.*")
