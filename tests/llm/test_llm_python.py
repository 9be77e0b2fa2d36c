import html
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmuration.llm import decontaminate, language, packing, toxicity, worker
from murmuration.llm.html_text import extract_main_text, main_text
from murmuration.llm.jaccard import similar_groups
from murmuration.llm.python_queries import tokenizer_path
from murmuration.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ html

def test_article_of_every_page(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op1_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        article = re.search(r"<article>(.*)</article>", pages[row.page_id], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_page_without_article_element():
    page = """<html><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="content"><div
    class="post"><h1>Title</h1><p>First paragraph of some length, with words &amp; more.</p><p>Second <a href="x">link</a> that
    goes&nbsp;on.</p><ul><li>one<li>two</ul></div><div class="comments"><p>A very long reader comment with many many words in it,
    longer than the rest of the page.</p></div></div><aside>side</aside><form><label>Name</label></form><footer>foot</footer>"""
    assert main_text(page) == ("Title\nFirst paragraph of some length, with words & more.\nSecond link that goes on.\none\ntwo")


def test_names_of_wrappers_leave_nothing_out():
    text = "".join(f"<p>Paragraph {i} of the article, with a good many words.</p>" for i in range(6))
    lines = "\n".join(f"Paragraph {i} of the article, with a good many words." for i in range(6))
    aside = "<div class='sidebar'><p>Beside the text.</p></div><div id='ad-3'>Buy now</div>"
    for wrapper in ("class='layout has-sidebar'", "class=no-sidebar", "class='content-with-sidebar'", "class='ad-free'",
                    "id='widget-area-content'", "class='sidebar'", "id=related", "role=form"):
        assert main_text(f"<body><div {wrapper}><article>{text}</article></div>{aside}</body>") == lines
        assert main_text(f"<body><div {wrapper}><div>{text}</div></div>{aside}</body>") == lines
    assert main_text(f"<body><form><div>{text}</div></form>{aside}</body>") == lines
    for name in ("share-price", "social-policy", "related-work"):
        assert main_text(f"<article>{text}<section class='{name}'><p>More.</p></section></article>") == lines + "\nMore."
    # A discussion longer than the article stays out, with articles of its own or without.
    talk = f"<p>{'chat ' * 40}</p>" * 5
    for inner in (talk, f"<article><p>{'chat ' * 20}</p></article>" * 8):
        assert main_text(f"<body><article>{text}</article><div class='comments'>{inner}</div></body>") == lines


def test_sibling_blocks_under_the_body():
    def paragraphs(name, n):
        return "".join(f"<p>{name} paragraph {i} of the article, with a good many words in it.</p>" for i in range(n))

    def lines(name, n):
        return [f"{name} paragraph {i} of the article, with a good many words in it." for i in range(n)]

    links = "<div><ul>" + "".join(f"<li><a href='{i}'>Another page {i}</a></li>" for i in range(8)) + "</ul></div>"
    for tag in ("section", "div", "article"):
        blocks = [f"<{tag}>{paragraphs(n, k)}</{tag}>" for n, k in (("First", 5), ("Second", 4), ("Third", 2))]
        whole = "\n".join(lines("First", 5) + lines("Second", 4) + lines("Third", 2))
        for page in ("".join(blocks), links + "".join(blocks) + "<div>Imprint</div>", links.join(blocks),
                     f"<div><div>{''.join(blocks)}</div></div>{links}"):
            assert main_text(f"<html><body>{page}</body></html>") == whole
    page = (f"<body>{links}<h1>Title</h1><section>{paragraphs('First', 5)}</section><h2>Part two</h2><p>Short.</p>"
            f"<section>{paragraphs('Second', 4)}</section>{links}</body>")
    assert main_text(page) == "\n".join(["Title", *lines("First", 5), "Part two", "Short.", *lines("Second", 4)])


def test_reader_comments_are_no_article():
    text = "".join(f"<p>Paragraph {i} of the article, with a good many words.</p>" for i in range(6))
    lines = "\n".join(f"Paragraph {i} of the article, with a good many words." for i in range(6))
    for n in (2, 8, 13, 60):
        talk = "".join(f"<p>Reader {i} says that this is so, and says it at some length.</p>" for i in range(n))
        for name in ("class=user-comments", "id='reader-feedback'", "class='discussion'", "id=commentsBlock", "class='post__comments'",
                     "class='comment-body'", "id='article-responses-2'"):
            for block in (f"<div {name}>{talk}</div>", f"<section {name}><article>{talk}</article></section>",
                          f"<article {name}>{talk}</article>"):
                for page in (f"<article>{text}</article>{block}", f"{block}<main>{text}</main>", f"<article>{text}{block}</article>",
                             f"<div><article>{text}</article></div><div>{block}</div>"):
                    assert main_text(f"<html><body>{page}</body></html>") == lines
        if n < 30:  # a block of unknown name after the article
            assert main_text(f"<body><article>{text}</article><div class='xyz'>{talk}</div></body>") == lines
    assert main_text(f"<body><div class='comments-enabled'><article>{text}</article></div></body>") == lines
    assert main_text(f"<body><div class='comments'><article>{text}</article></div><p>Imprint</p></body>") == lines


def test_large_pages_take_linear_time():
    n, start = 100_000, time.time()
    assert main_text("<div>" * n + "deep") == "deep"
    assert main_text("<b>" * n + "deep" + "</i>" * n) == "deep"
    assert main_text("<p><button>" + "<div>" * n + "deep") == ""
    assert main_text("text" + "<a " * n) == "text" + "".join(["<a "] * n).strip()
    assert len(main_text("<script></script" * n)) < 20
    assert main_text("<article>" + "<div class=sidebar>" * n + "x" * 50) == "x" * 50
    assert main_text("<article>words" + "<div class=sidebar>x</div>" * n) == "words"
    assert main_text("<ul>" + "<li>a" * n).count("a") == n
    assert main_text("<!-- " * n) == "" and main_text("<p>" + "'\"<" * n).startswith("'")
    assert time.time() - start < 60


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain &lt; text"), (4, "u", deep), (5, "u", "<p>a<p>b"),
            (6, "u", "<script>var x='</p>'"), (7, "u", "<a href='x>y"), (5, "u", "<p>a<p>b")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "plain < text", 12), (4, "deep", 4), (5, "a\nb", 3), (5, "a\nb", 3),
                          (6, "", 0), (7, "y", 1)], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


# ------------------------------------------------------------------ toxicity and language

def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    false_alarms = sum(r.predicted for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows)
    assert got.count() == 10_000 and right > 0.9 and false_alarms < 0.05
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def toxic_rows(spark):
    rng = random.Random(3)
    words = ["lamp", "river", "stone", "cloud", "paper", "green", "walk", "seven", "table", "sound"]
    rows = [(i, " ".join(rng.choices(words, k=40) + (["blighter", "scoundrel"] if i % 4 == 0 else [])), int(i % 4 == 0))
            for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")


def test_misspellings_and_odd_rows(spark):
    docs, labels = toxic_rows(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows = spark.createDataFrame([(1, "stone lamp scoundrell table"), (2, "stone lamp table"), (3, None), (4, ""), (None, "river"),
                                  (1, "stone lamp scoundrell table"), (6, "lamp " * 50_000)], "doc_id long, text string")
    got = [(r.doc_id, r.predicted, r.score) for r in toxicity.scores(rows, model).collect()]
    assert [g[:2] for g in got] == [(1, 1), (2, 0), (3, 0), (4, 0), (None, 0), (1, 1), (6, 0)]
    assert all(0 <= g[2] <= 1 for g in got) and got[2][2] == got[3][2] and got[0] == got[5]
    assert toxicity.scores(rows.limit(0), model).count() == 0
    assert toxicity.scores(docs, model).columns == ["doc_id", "text", "score", "predicted"]
    none = toxicity.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert {r.predicted for r in toxicity.scores(rows, none).collect()} == {0}


def test_language_of_held_out_rows(spark, sf):
    got = QUERIES["op7_language_spans"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_samples_take_one_row_of_a_repeated_id(spark, monkeypatch):
    docs, labels = toxic_rows(spark)
    docs = docs.select("doc_id", "text")
    more = docs.where("doc_id = 4").crossJoin(spark.range(500)).select("doc_id", F.concat("text", F.lit(" w"), "id").alias("text"))
    trained = []
    train = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda bags, *rest: trained.append(len(bags)) or train(bags, *rest))
    received = []
    collected = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda frame: received.append(collected(frame)) or received[-1])
    toxicity.fit(docs.unionByName(more), labels)
    assert received[0].num_rows == trained[0] <= 400
    rows = [(i, "the house and the garden " * 3, "en") for i in range(40)] + [(i, "les maisons et le jardin " * 3, "fr") for i in range(40, 80)]
    named = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = named.where(~language.held_out()).limit(1).first()
    again = spark.createDataFrame([(own.doc_id, own.text, own.lang)] * 300, named.schema)
    language.fit(named)
    language.fit(named.unionByName(again))
    once, twice = (sorted(tuple(r.values()) for r in x.to_pylist()) for x in received[-2:])
    assert once == twice


def viterbi_brute(scores, penalty):
    best = {j: (0.0, []) for j in range(scores.shape[1])}
    for row in scores:
        best = {j: max(((v - (penalty if p and p[-1] != j else 0) + row[j], [*p, j]) for v, p in best.values()),
                       key=lambda x: x[0]) for j in best}
    return max(v for v, _ in best.values())


def test_viterbi_and_its_shortcut():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.normal(0, 3, (rng.integers(1, 12), 3))
        scores -= scores.max(axis=1, keepdims=True)
        path = language.viterbi(scores, 4.0)
        value = scores[np.arange(len(path)), path].sum() - 4.0 * (path[1:] != path[:-1]).sum()
        assert abs(value - viterbi_brute(scores, 4.0)) < 1e-9
        whole = language._one_language(scores, 4.0)
        assert whole is None or abs(scores[:, whole].sum() - value) < 1e-9


def test_spans_scripts_and_odd_rows(spark):
    english, french = "the house and the garden with the river ", "les maisons et le jardin avec une rivière "
    rows = [(i, (english if i % 2 else french) * 3, "en" if i % 2 else "fr") for i in range(60)]
    rows += [(i, "дом и сад у реки " * 3, "ru") for i in range(60, 90)] + [(90, None, "en"), (91, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, english * 4 + french * 4), (2, "сад"), (3, None), (4, "12 !"), (None, english), (6, "日本"),
                                   (1, english * 4 + french * 4)], "doc_id long, text string")
    got = language.identify(asked, model).collect()
    assert [[s["lang"] for s in r.lang_spans] for r in got] == [["en", "fr"], ["ru"], [], [], ["en"], ["en"], ["en", "fr"]]
    assert [(r.lang_pred, r.score) for r in got][2:4] == [("und", 0.0)] * 2 and got[0] == got[6]
    assert language.identify(asked.limit(0), model).count() == 0
    assert language.identify(asked, language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


# ------------------------------------------------------------------ packing

def test_chunked_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    texts = ["", " a", "a ", " ", "a  b", "x\n y", "<|endoftext|> a <|endoftext|>", "a b c", "don't stop 's 'll", "日本 語 é", "a\x1cb c",
             "a\x85 b", "  ", "\n", "w" * 5000 + " x", "word, word. word\nNext line, 12 3.5 %%% &&&"]
    texts.append(" ".join(random.Random(1).choices(texts[6:9] + ["alpha", "beta,", "gamma."], k=5000)))
    got = packing.encoded_texts(PATH, texts)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_odd_strings_have_the_tokenizers_ids():
    whole, rng = Tokenizer.from_file(PATH), random.Random(2)
    odd = ["a", "B", "'", "'ll", "é", "ß", "²", "½", " ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", ".", ",", "__", "我", "\u200b",
           "<|endoftext|>", "x" * 60, "\U0001F600", "\u0120", "ª"]
    for _ in range(8):
        texts = ["".join(rng.choices(odd, k=rng.randint(0, 25))) for _ in range(500)]
        got = packing.encoded_texts(PATH, texts, False)
        assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_recent_values_are_bounded_in_bytes():
    recent = worker.Recent(1 << 20)
    for i in range(200):
        keys = [f"{i} {k}" for k in range(200)]
        assert [recent.fill(keys, lambda new: [k + "!" for k in new])[k] for k in keys] == [k + "!" for k in keys]
    assert 200 < len(recent.new) + len(recent.old) < (3 << 19) / worker.ENTRY_BYTES
    store = sys.modules["_murmuration_worker"].__dict__
    assert worker.kept("a", "x", lambda: 1) == 1 and worker.kept("b", "y", lambda: 2) == 2 and "kept x" not in store


def check_packed(rows, texts):
    """Every id in one piece, sequences gapless and within the capacity; returns (sequences, ids)."""
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*whole.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark, sf):
    rows = QUERIES["op5_harmonic_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sequences, ids = check_packed(rows, texts)
    assert sequences * packing.CAPACITY <= 1.03 * ids


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (4, "b " * 9000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    check_packed(packing.packed(docs, tokenizer_path()).collect(), dict(rows))
    assert packing.packed(docs.limit(0), tokenizer_path()).count() == 0
    repeated = packing.packed(docs.unionByName(docs), tokenizer_path())
    assert repeated.where("doc_id = 2").count() == 2


def test_chunks_that_are_white_space_alone_among_known_ones():
    whole = Tokenizer.from_file(PATH)
    # The words are known before, so the odd chunk is the only one that is not.
    for texts in (["aa bb cc"], ["aa bb  cc"], ["aa \n bb"], ["aa \nbb cc"], ["aa bb\n cc"], ["aa  bb", "aa bb "]):
        expected = [whole.encode(text, add_special_tokens=False).ids for text in texts]
        assert [ids.tolist() for ids in packing.encoded_texts(PATH, texts, False)] == expected


def test_words_are_encoded_once_whatever_stands_behind_them(monkeypatch):
    whole, sent, encode = Tokenizer.from_file(PATH), [], packing.Encoder.encode
    words = ["zürbelqua", "quomblarre", "ñandvöpp", "Жолтрубец"]
    before = [" ".join(["x", *words, *("other" + rest for rest in [",", "!!", ".\nThen", "'s"])])]
    after = [f"x {rest.join(words)}{rest}{word}" for word in words for rest in [", ", "!! ", ".\nThen ", "'s "]]
    packing.encoded_texts(PATH, before, False)
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: (sent.extend(texts), encode(self, texts))[1])
    got = packing.encoded_texts(PATH, after, False)
    assert set(sent) == {"x"}
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in after]


def test_known_words_are_bounded_in_bytes():
    rng, known = random.Random(3), packing.Known(1 << 16)
    compute = lambda new: (np.array([int(w) for w in new for _ in range(1 + int(w) % 3)], dtype="<u4"), np.array([1 + int(w) % 3 for w in new]))
    for _ in range(100):
        words = [str(w) for w in rng.sample(range(5000), 300)]
        ids, lengths = known.find(pa.array(words), compute)
        assert ids.tolist() == compute(words)[0].tolist() and lengths.tolist() == compute(words)[1].tolist()
        assert 0 < sum(24 + len(w) + 4 * n for w, n in zip(known.words.to_pylist(), known.lengths)) <= 1 << 16
        assert len(known.ids) == known.lengths.sum()
    known.find(pa.array(["9" * 9, *map(str, range(20000))]), compute)
    assert 0 < len(known.words) < 2000


def test_slices_are_bounded_by_their_text(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 100)
    texts = [None, "a b " * 90, "", "c d", "é " * 30, *["some words, and more"] * 20, None]
    parts = packing.slices(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]))
    assert [text for part in parts for text in part.column(1).to_pylist()] == texts
    assert len(parts) > 5 and all(sum(len((t or "").encode()) for t in part.column(1).to_pylist()[1:]) <= 360 for part in parts)
    assert packing.slices(parts[0].slice(0, 0)) == []
    expected = [Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for part in parts for ids in packing.encoded_texts(PATH, part.column(1), False)] == expected
    assert packing.encoded_texts(PATH, [], False) == []


def test_packed_ids_are_those_of_the_file_as_given(spark):
    whole = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z ", "plain words only", "a <|endoftext|>"]
    expected = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    assert 50256 in expected[0]
    assert [ids.tolist() for ids in packing.encoded_texts(PATH, texts, False)] == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.packed(docs, PATH).collect()
    for r in pieces:
        ids = np.array([*expected[r.doc_id], 0], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum(len(ids) + 1 for ids in expected)


def test_cuts():
    for length in range(1, 3000):
        pieces = packing.cut_lengths(length)
        assert sum(n for n, _ in pieces) == length
        assert all(packing.CAPACITY - packing.SLACK <= k * n <= packing.CAPACITY or n * k == n and k == 1 and length < 1024
                   or packing.CAPACITY - packing.SLACK <= k * n for n, k in pieces if k * n <= packing.CAPACITY)
        assert all(k * n <= packing.CAPACITY for n, k in pieces)


# ------------------------------------------------------------------ decontamination

def edit_brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(1500):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        text = "".join(rng.choices("abcd", k=rng.randint(0, 25)))
        assert decontaminate.best_match(decontaminate.char_masks(pattern), len(pattern), text) == edit_brute(pattern, text)


def test_matches_equal_brute_force():
    rng = random.Random(2)
    items = ["".join(rng.choices("abcdef ", k=rng.randint(8, 60))) for _ in range(12)]
    patterns = [p for p in (decontaminate.pattern_of(i, t, 0.1) for i, t in enumerate(items)) if p]
    matcher = decontaminate.Matcher(patterns)
    for _ in range(150):
        text = list("".join(rng.choices("abcdef ", k=60)) + rng.choice(items) + "".join(rng.choices("abcdef ", k=60)))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(["", "x", "aa"])
        text = "".join(text)
        normal = decontaminate.normal_form(text)
        expected = {(p.item_id, edit_brute(p.text, normal)[0]) for p in patterns if edit_brute(p.text, normal)[0] <= p.budget}
        got = matcher.matches(text)
        assert {(i, d) for i, d, _, _ in got} == expected
        for item, distance, start, end in got:
            assert edit_brute(next(p.text for p in patterns if p.item_id == item), normal[start:end])[0] == distance


def test_leaks(spark, sf):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items
             if decontaminate.normal_form(i.text) in decontaminate.normal_form(d.text or "")}
    assert exact <= got and len(got) <= len(exact) + 2


def test_items_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, items).select("doc_id").collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == whole and whole
    assert {r.doc_id for r in decontaminate.clean_documents(docs, items).select("doc_id").collect()} == clean


def test_leaks_odd_rows(spark):
    items = spark.createDataFrame([(1, "The  quick brown fox jumps"), (2, None), (3, " "), (1, "the quick brown fox jumps")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "so THE quick\nbrown fix jumps."), (2, None), (3, ""), (None, "the quick brown fox jumps"),
                                  (5, "x " * 60_000), (1, "so THE quick\nbrown fix jumps.")], "doc_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, 1, 1, 3, 28), (1, 1, 1, 3, 28), (None, 1, 0, 0, 25)], key=str)
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [2, 3, 5]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == 6


# ------------------------------------------------------------------ Jaccard join

def groups_brute(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        sets.append((doc_id, {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5
                     else {tuple(words)} if words else set()))
    label = {doc_id: doc_id for doc_id, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is None or b is None or not x or not y or label[a] <= label[b]:
                    continue
                if 100 * len(x & y) >= 80 * len(x | y):
                    label[a], changed = label[b], True
    return sorted(((d, len(s), label[d] if d is not None else None) for d, s in sets), key=str)


def joined(spark, rows):
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n int, cls string")
    return sorted((tuple(r) for r in similar_groups(docs).collect()), key=str)


def test_groups_of_copies_and_chains(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    shared = rng.choices(words, k=60)
    rows = []
    for base in range(6):
        text = rng.choices(words, k=rng.choice([30, 80, 200])) + (shared if base % 2 else [])
        for copy in range(14):  # a chain: each copy changes the one before
            rows.append((len(rows) * 7 % 101, " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if copy % 5 == 4:
                text = text[:int(len(text) * 0.9)]
    rows += [(200 + i, " ".join(rng.choices(words, k=40) + shared)) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \t "), (303, "A b"), (304, "a B"), (305, "b a"), (306, "one TWO three four five"),
             (307, "one two three four five"), (None, "a b"), (303, "A b"), (308, "é è"), (309, "É È"), (310, "x y z " * 9000)]
    assert joined(spark, rows) == groups_brute(rows)


def test_pairs_at_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for case in range(40):
        n = rng.randint(9, 70)
        base = [f"c{case}_{i}" for i in range(n + 4)]
        cut = rng.randint(0, n // 3)
        rows += [(2 * case, " ".join(base)), (2 * case + 1, " ".join(base[cut:]))]
    got = joined(spark, rows)
    assert got == groups_brute(rows)
    assert 0 < sum(component != doc for doc, _, component in got) < 40


def test_few_words_alone_and_together(spark):
    rows = [(n, " ".join("abcdefgh"[:n])) for n in range(9)]
    for row in rows:
        assert joined(spark, [row]) == groups_brute([row])
    assert joined(spark, rows) == groups_brute(rows)


def test_one_large_group_of_near_copies(spark):
    """Copies that differ from one text in a few words each, so that many are pivots and centres."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"e{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    assert joined(spark, rows) == groups_brute(rows)


def test_no_rows(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_members_of_unlinked_centres_are_compared(spark):
    """Stars whose centres are too far apart, while a member of either is near the other: only members link them."""
    base = [f"b{i}" for i in range(204)]
    rows = []
    for step in range(0, 44, 4):
        text = base[step:] + [f"t{i}" for i in range(step)]
        rows.append((step, " ".join(text)))
        rows.append((1000 + step, " ".join(text[:-1] + [f"e{step}"])))
    got = joined(spark, rows)
    assert got == groups_brute(rows) and Counter(c for _, _, c in got).most_common(1)[0][1] > 4
