import hashlib
import os
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from murmuration.llm import licenses
from murmuration.llm.chat import chat_examples, read_back
from murmuration.llm.dedup import duplicate_groups
from murmuration.llm.licenses import KNOWN_LICENSES, known_digests, license_scan
from murmuration.llm.queries import ORACLES, QUERIES
from murmuration.llm.shards import document_shards, kd_assign

DOCS = "doc_id long, text string, lang string, source string, digest string, weight int"  # with names the operators use
ROWS = [(1, "Hello", "en", "a", "x", 1), (2, "hello", "en", None, "x", 1), (3, None, None, "b", None, None),
        (4, "", "fr", "b", "y", 2), (None, "hello", "en", "a", "x", 3), (5, "ÄB", "de", "a", "x", 1), (6, "äb", "de", "a", "x", 1),
        (2, "hello", "en", None, "x", 1), (7, "word " * 20_000, "en", "a", "x", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    expected = db.sql(ORACLES[name])
    got = QUERIES[name](spark, sf).select(*expected.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))


def brute_duplicates(rows):
    def norm(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")

    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        own = groups[norm(text)]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_duplicates(spark, docs):
    assert sorted(map(tuple, duplicate_groups(docs).collect()), key=str) == brute_duplicates(ROWS)
    assert duplicate_groups(docs.limit(0)).count() == 0


def test_one_digest_of_different_texts_merges_nothing(docs):
    got = duplicate_groups(docs, digest=lambda text: F.lit("same"))
    expected = [(d, k, n, kept) for d, k, n, kept, _ in brute_duplicates(ROWS)]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(expected, key=str)


def test_many_copies_of_one_text(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = duplicate_groups(rows).where("group_size > 1")
    assert got.count() == 667 and got.where("kept").collect()[0].doc_id == 1998


def test_shards_are_near_equal_and_numbered(spark, docs):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("a"), F.lit(200)))
        .otherwise(F.repeat(F.lit("b"), (F.col("id") % 977).cast("int"))).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    got = document_shards(rows).collect()
    assert len(got) == 5000 and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 2 * 985
    for shard in range(24):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    few = document_shards(docs).collect()
    assert len(few) == len(ROWS) and all(0 <= r.shard < 24 for r in few)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in few if r.doc_id in (3, 4)} == {(3, 8, 0), (4, 8, 0)}
    assert document_shards(docs.limit(0)).count() == 0


def test_equal_rows_are_split(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("d"), F.lit(10).cast("long").alias("weight"),
                                    F.col("id").alias("tie"))
    counts = {r.shard: r["count"] for r in kd_assign(rows, ["d"], 8).groupBy("shard").count().collect()}
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 2


TURNS = [(1, 0, "user", "a<|end|>\\"), (1, 1, "assistant", "<|turn|>\\<|says|>x\\\\"), (1, 2, "user", None), (1, 2, "user", None),
         (1, 3, "assistant", "é\n"), (1, 4, "user", "late"), (2, 0, None, "only"), (3, 0, "assistant", ""), (None, 0, "user", "n")]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in read_back(chat_examples(turns)).collect()}
    for conv in {t[0] for t in TURNS}:
        own = [(role or "", text or "") for c, _, role, text in TURNS if c == conv]
        loss = "".join(text for role, text in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_examples(turns).where("conv_id = 1").orderBy("example").collect()
    assert [e.loss_length > 0 for e in examples] == [True, True, False]
    assert all(a.text == b.text[:len(a.text)] for a, b in zip(examples, examples[1:]))
    assert chat_examples(turns.limit(0)).count() == 0


def test_licenses(spark, docs):
    mit = KNOWN_LICENSES[1][1]
    changed = "Copyright © 2020 Somebody\n" + mit.upper().replace("\"", "“").replace(",", " ,\n")
    rows = spark.createDataFrame([(1, changed), (2, "text\n  RELEASED under the MIT Licence!\nmore"), (3, None), (4, "MIT"),
                                  (5, mit + " and more"), (6, "Copyright 2020\n")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(rows, known_digests(spark)).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None and got[2].line_licenses == ["MIT"]
    assert all(got[i].license_id is None and got[i].n_lines == 0 for i in (3, 4, 5, 6))
    assert license_scan(docs, known_digests(spark)).count() == sum(1 for _ in ROWS)
    assert license_scan(docs.limit(0), known_digests(spark)).count() == 0


def test_licenses_of_rows_that_share_an_id(spark):
    rows = [(1, "bar baz"), (1, "Licensed under the MIT License."), (None, "Licensed under the MIT License."), (None, "foo")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()
    assert sorted((str(r.doc_id), r.line_licenses, r.n_lines) for r in got) == [
        ("1", [], 0), ("1", ["MIT"], 1), ("None", [], 0), ("None", ["MIT"], 1)]


def test_common_licenses_and_notices(spark):
    folder = os.path.join(os.path.dirname(licenses.__file__), "license_texts")
    texts = {name: open(os.path.join(folder, name), encoding="utf-8").read() for name in os.listdir(folder)}
    texts["BSD-2-Clause"] = re.sub(r"3\. Neither[^.]*\.", "", texts["BSD-3-Clause"])
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} < set(texts)
    notices = {"This software is licensed under the Apache License 2.0": "Apache-2.0", "Distributed under the GPLv2.": "GPL-2.0",
               "Licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0", "SPDX-License-Identifier: MIT": "MIT",
               "This program is released under the terms of the GNU General Public License, version 3, or later": "GPL-3.0-or-later",
               "Released under the BSD 3-Clause License.": "BSD-3-Clause",
               "Licensed under the Creative Commons Attribution 4.0 International License.": "CC-BY-4.0"}
    rows = [(name, f"Copyright (c) 2021, Some One\nAll rights reserved.\n\n{text}", None) for name, text in texts.items()]
    rows += [(notice, f"prose\n{notice}\nprose", name) for notice, name in notices.items()]
    got = license_scan(spark.createDataFrame(rows, "doc_id string, text string, line string"), known_digests(spark)).collect()
    assert {r.doc_id: r.license_id for r in got if r.doc_id in texts} == {name: name for name in texts}
    assert {r.doc_id: r.line_licenses for r in got if r.doc_id in notices} == {n: [name] for n, name in notices.items()}


def test_licenses_wrapped_at_every_width(spark):
    """Prose lines that begin with "copyright" stay, whatever the width; notices on a line of their own do not count."""
    notice = re.compile(licenses.COPYRIGHT_LINE)
    texts = {}
    for name, text in KNOWN_LICENSES:
        if len(text) > max(500, len(texts.get(name, ""))):
            texts[name] = text
    rows = []
    for name, text in texts.items():
        for width in range(40, 101):
            lines, prose = [], []
            for line in [*text.split("\n"), ""]:
                own = notice.match(line.lower()) is not None
                if own or not line.strip():
                    lines += [*textwrap.wrap(" ".join(prose), width, break_long_words=False), line]
                    prose = []
                else:
                    prose.append(line.strip())
            rows.append((name, width, "Copyright 2020 Some One\n" + "\n".join(lines)))
    wrapped = licenses.with_canonical_lines(spark.createDataFrame(rows, "name string, width int, text string").repartition(32))
    got = wrapped.select("name", "width", F.sha2(licenses.canonical_text("lines"), 256).alias("digest"))
    known = known_digests(spark).select("digest", "license_id")
    found = got.join(F.broadcast(known), "digest", "left").where("license_id is null or license_id <> name")
    # At these widths a sentence of its Exhibit A, "All Rights Reserved.", has a line of its own, which is a notice elsewhere.
    assert len(texts) >= 19 and sorted(map(tuple, found.select("name", "width").collect())) == [("MPL-1.1", w) for w in range(83, 87)]


def test_lines_that_are_notices(spark):
    kept = ["Copyright holders be liable", "copyright notice and this", "(c) You must retain", "Copyright law", "All rights reserved by law"]
    gone = ["Copyright 2020 Some One", "COPYRIGHT (C) Some One", "(c) 1999 x", "© Some One", "Copyright <year> <holder>", "(c) Copyright 2001",
            "Copyright [yyyy] [name of copyright owner]", "Copyright The Go Authors.", "Copyright Some Firm, Inc.", "All rights reserved."]
    rows = spark.createDataFrame([(i, f"first\n{line}\nlast") for i, line in enumerate(kept + gone)], "doc_id int, text string")
    digests = {r.doc_id: r.text_digest for r in license_scan(rows, known_digests(spark)).collect()}
    bare = hashlib.sha256(b"first last").hexdigest()
    assert [digests[i] == bare for i in range(len(digests))] == [False] * len(kept) + [True] * len(gone)
