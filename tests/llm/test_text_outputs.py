import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import docs_of
from pyspark.sql import functions as F
from test_language_and_lm import words_of

from lexaspark.llm import decontamination, html_extraction, licenses, queries, token_output

PATH = token_output.default_path()


# --- HTML


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<nav>menu</nav><article><h1>T &lt;1&gt;</h1><p>a <b>b<br>c<p>d</p></article><footer>f</footer>", "T <1>\n\na b c\n\nd"),
        ("<div class='ad big'>x</div><main><header><h1>T</h1></header><p>one\n  two\t three</p><div id=comments>no</div><script>var a='<p>x</p>';</script></main>", "T\n\none two three"),
        ("<article>loose <p>p<ul><li>x<li>y</ul>tail<form><input value=z>q</form></article>", "loose\n\np\n\nx\n\ny\n\ntail"),
        ("<p>no main</p><aside>s</aside><p hidden>h</p><p style='display: none'>h</p>", "no main"),
        ("<article><!-- c --><style>p{}</style><p>a</article></p></div><p>after", "a"),
        ("<a" * 30, "<a" * 30),
        ("1 < 2 <3 </ 4> a<b", "1 < 2 <3 </ 4> a<b"),
        ("x <!-- open", "x"),
        ("<p title='a > b' class = big data-x=1>one</p><p it's>two</p><p a=\"x>three", "one\n\ntwo\n\nthree"),
        ("<article><header><h1>Title</h1></header><p>text of it</p></article>", "Title\n\ntext of it"),
        ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\n\ner"),
    ],
)
def test_pages(page, want):
    assert html_extraction.extract(page) == want


@pytest.mark.parametrize(
    "page",
    ["<a" * 100_000, "if a <b and c " * 20_000, "<b>" * 40_000 + "</i>" * 40_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<a b='>' " * 30_000, '<a b="' * 30_000 + ">", "<li>" * 50_000, "<td><tr>" * 20_000, "<p>" * 30_000 + "</p>" * 30_000, "</script " * 20_000 + "<script>" + "</script " * 20_000],
    ids=range(10),
)
def test_hostile_pages_take_linear_time(page):
    """Ten times the page takes no more than some twenty times as long."""

    def seconds(source):
        began = time.process_time()
        html_extraction.extract(source, {1: True})
        return time.process_time() - began

    assert seconds(page) < max(0.5, 20 * seconds(page[: len(page) // 10]) + 0.3)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, hash string")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_site_templates_go(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extraction, "BROADCAST_HASHES", limit)
    box = "<div><div>Read our other pages</div></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<p>Text {i}</p><p>Shared passage.</p></body>") for i in range(6)]
    rows += [(10 + i, "http://b.example/1", "<article><p>One article, many copies.</p></article>") for i in range(5)]
    rows += [(20, None, f"<body>{box}<p>x</p></body>"), (21, "http://a.example/9", None), (None, "no host", "<p>y</p>"), (0, "http://a.example/0", rows[0][2])]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_extraction.extract_pages(pages_of(spark, rows)).collect()}
    assert got[3, "http://a.example/3"] == ("Text 3\n\nShared passage.", 23)
    assert got[12, "http://b.example/1"][0] == "One article, many copies."
    assert got[20, None][0] == "Read our other pages\n\nx" and got[21, "http://a.example/9"] == ("", 0) and got[None, "no host"] == ("y", 1)
    assert html_extraction.extract_pages(pages_of(spark, rows)).count() == len(rows)
    assert html_extraction.extract_pages(pages_of(spark, [])).count() == 0


def test_articles_are_not_the_text_if_more_stands_around_them():
    body = " ".join(f"word{i}" for i in range(40))
    teasers = "".join(f"<article><header><h2>Teaser {i}</h2></header><p>{'more words ' * 12}</p></article>" for i in range(5))
    got = html_extraction.extract(f"<nav>n</nav><div class=body><p>{body}</p></div>{teasers}<footer>f</footer>")
    assert got.startswith(body + "\n\nTeaser 0\n\nmore words") and "Teaser 4" in got
    assert html_extraction.extract(f"<p>around</p><article><p>{body}</p></article>{'<article><p>x y</p></article>' * 2}") == body + "\n\nx y" * 2


def test_copies_keep_their_text(spark):
    body = f"<div class=body>{'long text of it ' * 20}</div>"
    rows = [(i, f"http://c.example/{i}", f"<article><h1>T</h1>{body}</article>") for i in range(4)]
    rows += [(10 + i, f"http://d.example/{i}", f"<div><h1>T</h1>{body}</div>") for i in range(4)]
    rows += [(20 + i, f"http://e.example/{i}", f"<p>count {i}</p><article><h1>T{i}</h1>{body}</article>") for i in range(4)]
    want = " ".join(("long text of it " * 20).split())
    for r in html_extraction.extract_pages(pages_of(spark, rows)).collect():
        assert r["text"] == f"T{r['page_id'] - 20 if r['page_id'] >= 20 else ''}\n\n{want}"


def test_few_pages_of_many_are_no_template(spark):
    box = "<div>Here is a box</div>"
    rows = [(i, f"http://f.example/{i}", f"<p>Text {i}</p>{box if i < 4 else ''}") for i in range(300)]
    rows += [(1000 + i, f"http://g.example/{i}", f"<p>Text {i}</p>{box if i < 60 else ''}") for i in range(4000)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages_of(spark, rows)).collect()}
    assert got[0] == "Text 0\n\nHere is a box" and got[1000] == "Text 0"


def test_templates_of_any_element_go(spark):
    menu = "<ul><li><a href=/>Home</a><li>About</ul><table><tr><td>Layout</td></tr></table>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<div><p>Text {i} of the <b>United</b> Nations</p><p>Shared passage.</p></div><p>All rights reserved</p></body>") for i in range(5)]
    for r in html_extraction.extract_pages(pages_of(spark, rows)).collect():
        assert r["text"] == f"Text {r['page_id']} of the United Nations\n\nShared passage."


def brute_templates(rows, prior):
    """(host, hash, wide) from sets of main texts, page by page."""
    pages, holding, shapes = defaultdict(set), defaultdict(set), set()
    for url, source in rows:
        host, page = html_extraction.host_of(url), html_extraction.Page(source, prior)
        content = page.text()
        pages[host].add(content)
        known = page.hashes()
        for k, n in enumerate(page.nodes):
            if n.children and not any(page.gone[m.at] for m in page.nodes if m.at < k < m.end):
                holding[host, known[k]].add(content)
        for h in page.shapes().values():
            holding[host, h].add(content)
            shapes.add(h)
    out = set()
    for (host, h), found in holding.items():
        n, of = len(found), len(pages[host])
        if n >= 3 and (2 * n >= of if h in shapes else n >= min(50, 0.02 * of)):
            out.add((host, h, 2 * n >= of or n >= 50))
    return out


@pytest.mark.parametrize("prior", [True, False])
def test_templates_by_brute_force(spark, prior):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["url"], r["html"]) for r in pages.collect()]
    got = {tuple(r) for r in html_extraction.site_templates(pages, prior).collect()}
    assert got == brute_templates(rows, prior) and got


def test_templates_alone_find_the_text(spark):
    """With the lists of tags and names emptied and articles made plain containers, deleting what recurs on
    a host still leaves the same text of about half of all pages; without templates, of none."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1section>"))
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(plain, prior=False).collect()}
    none = {r["page_id"]: html_extraction.extract(r["html"], {}, False) for r in plain.collect()}
    host = {r["page_id"]: html_extraction.host_of(r["url"]) for r in pages.collect()}
    sizes = Counter(host.values())
    large = [i for i in want if sizes[host[i]] >= 5]
    assert sum(got[i] != none[i] for i in large) > 0.9 * len(large) and sum(none[i] == want[i] for i in large) == 0
    assert sum(got[i] == want[i] for i in large) > 0.4 * len(large)


# --- SQL oracles on odd rows


def by_sql(name, documents, benchmark=None):
    con = duckdb.connect()
    con.register("documents_df", documents.select("doc_id", "text").toPandas())
    con.sql("CREATE VIEW documents AS SELECT doc_id, text FROM documents_df")
    if benchmark is not None:
        con.register("benchmark_df", benchmark.toPandas())
        con.sql("CREATE VIEW benchmark AS SELECT CAST(item_id AS BIGINT) AS item_id, text FROM benchmark_df")
    found = con.sql(queries.ORACLE_SQL[name])
    return found.columns, found.fetchall()


def same(df, columns, rows):
    import pandas as pd

    norm = lambda x: None if x is None or (isinstance(x, float) and pd.isna(x)) else round(x, 6) if isinstance(x, float) else x
    key = lambda r: str(r)
    assert sorted((tuple(norm(v) for v in r) for r in df.select(*columns).collect()), key=key) == sorted((tuple(norm(v) for v in r) for r in rows), key=key)


def test_licenses_by_sql(spark, odd, nothing):
    more = [(20, "MIT license mit LICENSE"), (21, "mit  license; the Apache\nLicense"), (22, "general public the license"), (23, "Licensed under the GNU General Public License, version 3."), (24, "xmit license mit licenses"), (25, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (26, "Licensed under CC BY-NC 4.0."), (27, "GNU"), (29, "Copyright. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), (40, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"), (28, "GENERAL PUBLIC LICENSE" * 3)]
    docs = docs_of(spark, more).unionByName(odd)
    got = licenses.scan_licenses(docs)
    same(got, *by_sql("op8_license_scan", docs))
    at = {r["doc_id"]: r for r in got.collect()}
    assert (at[20]["n_base"], at[20]["first_word"], at[20]["last_word"], at[20]["base_labels"]) == (2, 0, 2, "mit")
    assert at[21]["base_labels"] == "apache,mit" and at[22]["n_base"] == at[24]["n_base"] == 0
    assert at[23]["labels"] == "gpl,gpl-3.0" and at[25]["labels"] == "mit" and at[25]["base_labels"] == "" and at[26]["labels"] == "cc-by-nc-4.0"
    assert at[29]["labels"] == "bsd" and at[29]["base_labels"] == "" and at[40]["labels"] == "gpl" and at[40]["n_base"] == 1
    assert at[5]["n_base"] == 12000 and licenses.scan_licenses(nothing).count() == 0


def test_every_template_is_gated():
    words = licenses.content_words()
    assert all(set(w) & set(words) for _, _, _, w, _ in licenses.templates())


def test_contamination_by_sql(spark, odd, nothing, documents, monkeypatch):
    w = [f"b{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(w[:12]), 0), (2, "Short item", 0), (3, None, 0), (4, "", 0), (10, " ".join(w[5:25]), 0), (2, "other Words", 0), (11, "same TEXT stands here twice mit", 0)], "item_id long, text string, n_words long")
    more = [(30, "x " + " ".join(w[:11]).upper() + ". y"), (31, " ".join(w[:9])), (32, "a short, item! and other\nwords"), (33, "xshort item"), (34, " ".join(w))]
    whole = decontamination.contamination(odd.where("doc_id = 5"), items).first()
    assert (whole["n_words"], whole["n_hit"]) == (120_000, 0)
    docs = docs_of(spark, more).unionByName(odd.where("doc_id IS NULL OR doc_id != 5"))  # the SQL can't take a text so long
    got = decontamination.contamination(docs, items)
    columns, rows = by_sql("op10_decontamination", docs, items.select("item_id", "text"))
    same(got, columns, rows)
    at = {r["doc_id"]: r for r in got.collect()}
    assert at[30]["n_hit"] == 11 and [(s["start"], s["end"]) for s in at[30]["spans"]] == [(2, 2 + len(" ".join(w[:11])))]
    assert at[31]["items_sha256"] == hashlib.sha256(b"").hexdigest() and at[34]["item_ids"] == ["1", "10"]
    clean = decontamination.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == got.where("NOT contaminated").count()
    assert decontamination.contamination(nothing, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 60)  # several passes, one result
    same(decontamination.contamination(docs, items), columns, rows)


# --- tokens


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_cached_tokenizer(text):
    tok = token_output.tokenizer(PATH)
    assert np.frombuffer(tok.encode([text])[0], tok.kind).tolist() == tok.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Don't stop! it's 12.5 ÄÖÜ ß ẞ", "a  b\tc\r\nd", "<|endoftext|> x<|startoftext|>y", "ΑΣ İstanbul é", "日本語", "..,, word;;: x!?", "a\x1cb c", "'s 's don''t", "ß&&& it's!! 'tis 'LL %%%x÷y×z ÿ\xa0\xad\x85 a1b22", "<|EndOfText|>"])
def test_cached_tokenizer_on_hard_texts(text):
    test_cached_tokenizer.hypothesis.inner_test(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 4))
def test_coder(tokens, stretch):
    tokens = np.array(tokens * stretch, np.int64)
    symbols, counts = np.unique(tokens, return_counts=True)
    freq = token_output.quantised(symbols, counts)
    assert not len(freq) or (freq.sum() == 1 << token_output.SCALE and freq.min() >= 1)
    coder = token_output.Coder(symbols, freq)
    assert (coder.decode(coder.encode(tokens)) == tokens).all()


def test_checkpoints_and_checksums():
    tokens = np.random.default_rng(0).integers(0, 40, 200_000)
    symbols, counts = np.unique(tokens, return_counts=True)
    coder = token_output.Coder(symbols, token_output.quantised(symbols, counts))
    frame = coder.encode(tokens)
    step = token_output.CHECKPOINT * token_output.LANES
    for k in range(len(tokens) // step):
        assert (coder.decode(frame, k) == tokens[(k + 1) * step :]).all()
    assert len(frame) < 200_000 * 0.76  # log2(40) bits are 0.665 bytes; states take the rest
    for at in (3, 30, len(frame) - 1):
        with pytest.raises(ValueError):
            coder.decode(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :])
    one = token_output.Coder(np.array([7]), token_output.quantised(np.array([7]), np.array([9])))
    assert (one.decode(one.encode(np.full(5000, 7))) == 7).all()


def expected(rows):
    tok, at, out = token_output.tokenizer(PATH).whole, 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_kept_values_are_bounded():
    made = []
    kept = token_output.Kept(lambda k: made.append(k) or k.encode(), 200 * 100)
    for _ in range(3):
        for i in range(1000):
            assert kept[str(i)] == str(i).encode() and kept["often"] == b"often"
    assert len(kept) + len(kept.before) <= 102 and made.count("often") == 1 and len(made) == 3001


def test_round_trip(spark, documents, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 3000)
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = token_output.token_output(documents.repartition(5)).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_odd_documents(spark, odd, nothing, tmp_path):
    got = [tuple(r) for r in token_output.token_output(odd).orderBy("start").collect()]
    ids = [g[0] for g in got]
    assert ids == [None, None, *sorted(i for i in ids if i is not None)] and len(ids) == odd.count()
    texts = {(i, zlib.crc32(str(t).encode())): t for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()]}
    plain = sorted((e[0] or -1, e[2], e[3]) for e in expected([(i, t) for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()]]))
    assert sorted((g[0] or -1, g[2], g[3]) for g in got) == plain and texts
    assert [g[1] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    assert token_output.token_output(nothing).count() == 0
    token_output.write_token_blocks(odd, str(tmp_path / "t"), PATH, end=9)
    for r in token_output.read_token_blocks(spark, str(tmp_path / "t"), ids=True).collect():
        assert r["ids"][-1] == 9 and len(r["ids"]) == r["n_tokens"]


def test_word_pattern():
    assert re.findall("x", "x") and words_of("A-b C") == ["a", "b", "c"]
