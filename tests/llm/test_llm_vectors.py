import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import centroids, repeats, whitening
from murmuration.llm.queries import ORACLES, QUERIES

INF, NAN = float("inf"), float("nan")


def held_against_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    expected, frame = db.sql(ORACLES[name]), QUERIES[name](spark, folder)
    assert frame.columns == expected.columns
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected.fetchall(), key=str)


# ------------------------------------------------------------------ clustering

def test_clusters_equal_sql(spark, sf):
    held_against_sql(spark, sf, "op11_centroid_clustering")


def clusters_brute(rows, k, rounds):
    rows = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centres = [v for _, v in starts]

    def assign():
        out = []
        for _, v in rows:
            distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((min(distances), distances.index(min(distances))))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (_, at) in zip(rows, where) if at == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    where = assign()
    inertia = Counter()
    for d, c in where:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(rows, where)), key=str)


@pytest.mark.parametrize("case", ["mixed", "few", "large"])
def test_clusters_equal_brute_force(spark, case):
    rng = random.Random(case)
    size = {"mixed": 1.0, "few": 1.0, "large": 30000.0}[case]
    rows = [(i, [rng.gauss(i % 3, 1) * size for _ in range(64)]) for i in range(3 if case == "few" else 90)]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[0][1]), (900, None), (901, [1.0] * 63), (902, []), (903, [1.0] * 63 + [None]),
             (904, [NAN] + [0.0] * 63), (905, [0.0] * 63 + [-INF]), (906, [0.0] * 65)]
    rows += [(1000 + i, rows[1][1]) for i in range(40)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = sorted((tuple(r) for r in centroids.cluster_vectors(vectors, 16, 2).collect()), key=str)
    assert got == clusters_brute(rows, 16, 2)


def test_no_vectors_to_cluster(spark):
    empty = spark.createDataFrame([(1, None), (None, [0.0] * 64)], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(empty).count() == 0
    assert centroids.cluster_vectors(empty.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert {r.distance for r in centroids.cluster_vectors(huge).collect()} == {0}


# ------------------------------------------------------------------ whitening

def whitened_brute(rows, weights, components=16):
    rows = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    common = Counter(len(v) for _, v in rows)
    width = max(common, key=lambda w: (common[w], w))
    rows = [(i, v) for i, v in rows if len(v) == width]
    copies = Counter(v for _, v in rows)
    fit = [v for v, n in copies.items() for _ in range(n if weights == "counts" else 1)]
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    centred = np.array([[float(a - Fraction(s, n)) for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, v in rows:
        z = np.array([float(a - Fraction(s, n)) for a, s in zip(v, sums)]) @ axes / np.sqrt(values)
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), z))
    return out, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(20, 20))
    base = (rng.normal(size=(150, 20)) @ mix).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[i % 3]) for i in range(70)] + [(0, base[0]), (None, base[1])]
    odd = [(500, None), (501, []), (502, [1.0] * 19), (503, [None] + [1.0] * 19), (504, [NAN] * 20), (505, [INF] + [0.0] * 19)]
    vectors = spark.createDataFrame([(i, v, 7) for i, v in rows + odd], "vec_id long, embedding array<double>, n int").repartition(4)
    got = whitening.whiten(vectors, weights=weights)
    assert got.columns == [f.split()[0] for f in whitening.RESULT.split(", ")]
    got = got.collect()
    expected, shares = whitened_brute(rows, weights)
    assert len(got) == 16 * len(rows) and {r.identity_error < 1e-9 for r in got} == {True}
    key = lambda r: (str(r[0]), r[2])
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.n, r.deviation), {})[r.component] = (r.whitened, r.explained)
    signs = None
    assert set(table) == {e[:3] for e in expected}
    for i, n, deviation, z in sorted(expected, key=key):
        own = table[i, n, deviation]
        w = np.array([own[c][0] for c in range(1, 17)])
        signs = np.sign(w * z) if signs is None else signs
        assert np.allclose(w, signs * z, atol=1e-8)
        assert np.allclose([own[c][1] for c in range(1, 17)], shares, rtol=1e-9)


def test_whitening_of_all_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected, shares = whitened_brute([(r[0], r[1]) for r in rows], "one")
    got = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    assert Counter((r.vec_id, r.n, r.deviation) for r in got) == Counter({e[:3]: 16 for e in expected})
    assert max(r.identity_error for r in got) < 1e-6 and len({r.identity_error for r in got}) == 1
    assert all(abs(r.explained - shares[r.component - 1]) < 1e-9 for r in got)
    z = {e[0]: e[3] for e in expected}
    assert all(abs(abs(r.whitened) - abs(z[r.vec_id][r.component - 1])) < 1e-6 for r in got)


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    assert whitening.whiten(same.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} > {None}


# ------------------------------------------------------------------ repeats

def removed_brute(rows, window=50):
    first, out = {}, []
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in rows]
    for i, words in split:
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    for i, words in split:
        gone = set()
        for a in range(len(words) - window + 1):
            if i is not None and first[tuple(words[a:a + window])] < i:
                gone.update(range(a, a + window))
        left = " ".join(w for a, w in enumerate(words) if a not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def without_repeats(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(6)
    return sorted((tuple(r) for r in repeats.remove_repeats(docs).collect()), key=str)


def test_repeats_equal_sql(spark, sf):
    held_against_sql(spark, sf, "op12_substring_dedup")


@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, small, monkeypatch):
    if small:  # many shards and salts
        monkeypatch.setattr(repeats, "SHARD_WORDS", 150)
        monkeypatch.setattr(repeats, "STREAM_WORDS", 300)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", "É", "é", "a\x85b", " "]
    passages = [rng.choices(words, k=k) for k in (49, 50, 51, 60, 99, 140, 300)] + [["la"] * 120, ["la", "lu"] * 60]
    rows = []
    for i in rng.sample(range(1000), 70):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices(words, k=rng.choice([0, 0, 1, 7, 40]))
            passage = rng.choice(passages)
            cut = rng.choice([0, 0, 0, 3, 20])
            text += passage[cut:]
        rows.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(text)))
    base = rng.choices(words, k=200)
    for i in range(2000, 2030):  # near copies
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(3000 + i, " ".join(base)) for i in range(12)] + [rows[5], (rows[6][0], rows[7][1]), (rows[6][0], " ".join(base)), (None, rows[8][1]),
             (None, None), (4000, None), (4001, ""), (4002, " \n "), (4003, " ".join(["la"] * 3000)), (-5, " ".join(base[20:90]))]
    assert without_repeats(spark, rows) == removed_brute(rows)


def test_window_lengths_alone(spark):
    base = [f"w{i}" for i in range(53)]
    for n in (48, 49, 50, 51, 52, 53):
        rows = [(1, " ".join(base[:n])), (2, "a " + " ".join(base[:n]) + " b")]
        assert without_repeats(spark, rows) == removed_brute(rows)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_against_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        runs = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))], rng.randint(0, 9)) for _ in range(rng.randint(1, 6))]
        automaton = repeats.Automaton()
        for words, document in runs:
            automaton.add(words, document)
        for document in (0, 4, 10):
            words, threshold = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)], rng.randint(2, 6)
            marked = set()
            for a in range(len(words) - threshold + 1):
                part = words[a:a + threshold]
                if any(d < document and part in [w[i:i + threshold] for i in range(len(w))] for w, d in runs):
                    marked.update(range(a, a + threshold))
            spans = automaton.spans(words, document, threshold)
            assert {i for a, b in spans for i in range(a, b)} == marked and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
