"""Toxicity scores: bags of subword embeddings averaged into a linear softmax, embeddings and softmax trained jointly."""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.worker import Recent, kept, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def marks() -> str:
    """Ranges of the combining characters, for a class of a pattern."""
    codes = [code for code in range(0x300, 0x1F000) if unicodedata.category(chr(code)).startswith("M")]
    starts = [code for i, code in enumerate(codes) if not i or codes[i - 1] != code - 1]
    ends = [code for i, code in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != code + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


WORD = re.compile(rf"(?:\w|[{marks()}])+")
CACHED_BYTES = 150 << 20  # of words and their numbers in a worker, by a high estimate


@dataclass(frozen=True)
class Shape:
    """Model and training parameters. The first two bound the labelled rows that the model is fitted on."""

    toxic_rows: int = 1500
    clean_rows: int = 3000
    least_documents: int = 10  # of the sample, in which a bucket must occur to get a vector
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    epochs: int = 10
    rate: float = 1.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    shape: Shape
    worth: np.ndarray  # per bucket: what its vector adds to the log-odds of class 1
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def subwords(word: str, shape: Shape) -> list[int]:
    """Buckets of a word and of its character n-grams; a misspelling shares most of them."""
    marked = f"<{word}>"
    grams = [marked]
    for n in range(shape.shortest, shape.longest + 1):
        grams += [marked[i:i + n] for i in range(len(marked) - n + 1)]
    return [zlib.crc32(gram.encode("utf-8", "replace")) % shape.buckets for gram in grams]


def _bag(text: str, shape: Shape) -> tuple[list[int], list[float]]:
    """A document as the average over its words of the average over their subwords: buckets and weights."""
    words = pd.Series(WORD.findall(text.lower())).value_counts()
    weights: dict[int, float] = {}
    total = float(words.sum())
    for word, n in words.items():
        own = subwords(word, shape)
        for bucket in own:
            weights[bucket] = weights.get(bucket, 0.0) + n / total / len(own)
    return list(weights), list(weights.values())


def _train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, clean_weight: float, shape: Shape) -> Model:
    """Adagrad over single documents. Buckets weigh by inverse document frequency in the sample; rare ones are left out.

    ``clean_weight`` is what a clean document counts against a toxic one, so that a sample of another mix does not
    shift the scores.
    """
    rng = np.random.default_rng(shape.seed)
    documents = np.zeros(shape.buckets)
    for buckets, _ in bags:
        documents[buckets] += 1
    rarity = np.where(documents >= min(shape.least_documents, 1 + len(bags) // 20),
                      np.log((len(bags) + 1) / (documents + 1)), 0.0)
    rarity = rarity.astype(np.float32)
    bags = [(b[rarity[b] > 0], (w * rarity[b])[rarity[b] > 0]) for b, w in bags]
    vectors = (rng.uniform(-1, 1, (shape.buckets, shape.dim)) / shape.dim).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (shape.dim, 2)), np.zeros(2)
    seen, seen_softmax, seen_bias = np.full(shape.buckets, 1e-10), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(shape.epochs):
        rate = shape.rate * (1 - epoch / shape.epochs)
        for i in rng.permutation(len(bags)):
            buckets, weights = bags[i]
            hidden = weights @ vectors[buckets]
            logits = hidden @ softmax + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            error *= 1.0 if labels[i] else clean_weight
            back = softmax @ error
            seen[buckets] += weights ** 2 * float(back @ back) / shape.dim
            vectors[buckets] -= (rate * weights / np.sqrt(seen[buckets]))[:, None].astype(np.float32) * back.astype(np.float32)
            step = np.outer(hidden, error)
            seen_softmax += step ** 2
            softmax -= 0.3 * rate * step / np.sqrt(seen_softmax)
            seen_bias += error ** 2
            bias -= 0.1 * rate * error / np.sqrt(seen_bias)
    worth = rarity * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    return Model(shape, worth.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Model:
    """Fit on at most ``shape.toxic_rows`` and ``clean_rows`` documents, chosen by a hash of the id among rows not held out.

    Ids that are labelled both ways, null labels and documents with a null id are left out. The bags are made where
    the documents are; the driver receives one of at most ``buckets`` entries per chosen id, of rows that repeat it the one with the least hash of its text. Without rows of both
    classes the model only knows which class it saw, and without any rows it calls every text clean.
    """
    known = (labels.where(~held_out()).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other"))
    mix = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    chosen = []
    for value, most in ((0, shape.clean_rows), (1, shape.toxic_rows)):
        chosen += (known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
                   .select("doc_id", "toxic").collect())  # as many rows as the parameters allow
    clean_weight = (max(1, mix.get(0, 0) / shape.clean_rows)) / max(1, mix.get(1, 0) / shape.toxic_rows)
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")

    def bags(frames):
        kept("bags", "nothing", lambda: None)  # lets go of what other operators left
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at:at + 64]
                rows = [_bag(text or "", shape) for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "toxic": part["toxic"].to_numpy(),
                                    "buckets": [np.array(r[0], dtype=np.int32) for r in rows],
                                    "weights": [np.array(r[1], dtype=np.float32) for r in rows]})

    single = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
              .agg(F.min_by("text", F.xxhash64("text")).alias("text")))  # of rows that repeat an id, one
    rows = (single.select("doc_id", "toxic", "text")
            .mapInPandas(bags, "doc_id long, toxic int, buckets array<int>, weights array<float>").toArrow())
    place = {doc_id: i for i, doc_id in enumerate(rows["doc_id"].to_pylist())}  # one row per id
    order = [place[doc_id] for doc_id in sorted(place)]
    toxic = rows["toxic"].to_numpy()[order]
    if len(set(toxic.tolist())) < 2:
        return Model(shape, np.zeros(shape.buckets, dtype=np.float32), 4.0 if 1 in toxic else -4.0)
    bags, weights = rows["buckets"], rows["weights"]
    return _train([(bags[i].values.to_numpy(), weights[i].values.to_numpy()) for i in order], toxic, clean_weight, shape)


def scores(docs: DataFrame, model: Model, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int) for every row's whole text.

    Being linear after training, the model adds up one number per word, which a worker remembers for recent words.
    A null or empty text, or one without words, has the score of the bias alone. Rows and other columns are unchanged;
    columns of the two result names are replaced. No rows give no rows.
    """
    opened, name = shared(docs.sparkSession, model)  # one float per bucket

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = opened()
        recent = kept(name, "words", lambda: Recent(CACHED_BYTES))

        def worth(words: list[str]) -> list[float]:
            return [float(model.worth[subwords(word, model.shape)].mean()) for word in words]

        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = WORD.findall(text.lower()) if text else []
            try:
                total = sum(map(recent.new.__getitem__, words))
            except KeyError:
                total = sum(map(recent.fill(words, worth).__getitem__, words))
            out[i] = total / max(1, len(words)) + model.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return (docs.withColumn(score_name, score(F.col("text")))
            .withColumn(predicted_name, (F.col(score_name) >= 0.5).cast("int")))
