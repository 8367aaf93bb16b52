"""Classifier, search, host rules, rotation, licences, pages and the pipeline."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences
from llm_helpers import documents, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hazardflow.llm import chat_rotation, host_rules, html_wrappers, license_scan, pivot_search, quality_classifier, queries
from hazardflow.llm.storage import stored

PYTHON = re.compile("Python|Pandas|Arrow")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, small, name):
    assert differences(queries.QUERIES[name](spark, small), connect(small), queries.ORACLES[name]) == []


def test_every_numbered_operator_is_registered():
    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_chat_rotation", "op10_host_rules"])
def test_native_operators_run_no_python(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON.search(plan)


# Quality classifier


def test_held_out_accuracy(spark, small):
    rows = queries.op1_quality_classifier(spark, small).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    learned = [(r.predicted, labels[r.doc_id]) for r in rows if not r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in learned]) > 0.9 and np.mean([a == b for a, b in held]) > 0.8


def test_classifier_on_odd_rows(spark):
    good = [(i, f"the quick fox {i} runs over a lazy dog and sleeps") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} $$$ BUY!! NOW!!") for i in range(60)]
    odd = [(500, None), (501, ""), (None, "the fox"), (502, "word " * 30_000), (0, good[0][1])]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, None), (None, 0)], "doc_id long, quality int")
    docs = documents(spark, good + bad + odd).withColumnRenamed("lang", "x").withColumnRenamed("source", "score")
    rows = quality_classifier.scored(docs, labels).collect()
    assert len(rows) == 125
    assert all(r.predicted == (r.doc_id < 100) for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    assert len({r.score for r in rows if r.doc_id in (500, 501)}) == 1
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert rows_of(kept.select("doc_id")) == rows_of(spark.createDataFrame([(r.doc_id,) for r in rows if r.predicted], "doc_id long"))
    untaught = quality_classifier.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in untaught} == {0.5}
    assert quality_classifier.scored(documents(spark, []), labels).count() == 0


def test_word_vectors_are_sums_over_all_documents(spark):
    texts = ["a b c d a", "d c b", "", "a", "E f!! g"] * 7
    places, signs = quality_classifier.index_vectors()
    whole = np.zeros((quality_classifier.VOCABULARY, quality_classifier.DIMS))
    for t in texts:
        found, _ = quality_classifier.tokens([t])
        for i, x in enumerate(found):
            for k in (-2, -1, 1, 2):
                if 0 <= i + k < len(found):
                    np.add.at(whole[x], places[found[i + k]], signs[found[i + k]])
    length = np.linalg.norm(whole, axis=1, keepdims=True)
    docs = documents(spark, enumerate(texts)).select("doc_id", "text").repartition(5)
    got = quality_classifier.word_vectors(docs)
    assert np.allclose(got, whole / np.where(length > 0, length, 1), atol=1e-6)


def test_tokens_are_runs_of_one_class():
    found, at = quality_classifier.tokens(["The THE the", "", "a!! b2 été"])
    assert np.diff(at).tolist() == [4, 0, 5] and found[1] != found[2] and len(set(found[4:].tolist())) == 5


# Pivot search


def brute_top(rows, top=5, scale=256):
    ok = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            ok.setdefault(i, []).append(np.floor(scale * np.array(x, dtype=np.float64)))
    out = []
    width = max((len(x) for xs in ok.values() for x in xs), default=0)
    full = [(i, np.pad(x, (0, width - len(x)))) for i, xs in ok.items() for x in xs]
    for q in sorted(i for i in ok if i % 50 == 0):
        own = np.pad(ok[q][0], (0, width - len(ok[q][0])))
        best = sorted((-int(own @ x), i) for i, x in full if i != q)[:top]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block", [16, 8192])
def test_search_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)]  # many equal vectors: ties go to smaller ids
    rows += [(2000, None), (2050, [None] * 12), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (None, rows[0][1])]
    rows += [(3000, [0.5] * 5), (-50, [0.25] * 12), (3050, [0.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS part", "2 AS score")
    got = pivot_search.top_k(frame, F.col("vec_id") % 50 == 0, block=block)
    assert rows_of(got) == sorted(brute_top(rows), key=repr)


def test_search_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    is_query = F.col("vec_id") % 50 == 0
    assert pivot_search.top_k(spark.createDataFrame([], schema), is_query).count() == 0
    assert pivot_search.top_k(spark.createDataFrame([(0, [1.0, 2.0])], schema), is_query).count() == 0
    two = pivot_search.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.5, 0.5])], schema), is_query)
    assert rows_of(two) == [(0, 1, 3, 256 * 128 + 512 * 128)]


def test_bounds_spare_work():
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 40, (20, 32))
    x = np.floor(centers[rng.integers(0, 20, 4000)] + rng.normal(0, 2, (4000, 32)))
    chosen = pivot_search.choose_pivots(x[:512], 32)
    table = pivot_search.PivotTable(chosen, x[chosen], (x * x).sum(axis=1).max())
    ids = np.arange(4000)
    q = x[:50]
    found, work = pivot_search.best(q, ids[:50], table.distances(q, True), np.full(50, -np.inf), x, ids, table.distances(x), table.radius, 5)
    assert work < 0.5 * 50 * 4000
    scores = q @ x.T
    np.fill_diagonal(scores[:, :50], -np.inf)
    for i in range(50):
        assert sorted((s for a, _, s in found if a == i), reverse=True) == sorted(scores[i], reverse=True)[:5]


# Host rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeated)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_rules_on_odd_rows(spark):
    repeat = "a b c d e f g h " * 5
    texts = [
        None, "", " \t\x0b\n", "one", repeat, repeat + " ".join(f"w{i}" for i in range(100)), "x\n\nx\n x\nx", "\n".join(["same line"] * 30),
        "# * $ % & | < >" * 3, "é 日本 🙂 " * 12, "w " * 20_000, " ".join(f"v{i % 50}" for i in range(400)), "\xa0 \x1c a", "t " * 8, "t " * 7,
    ]
    docs = documents(spark, [(i, t, None if i % 3 else f"h{i % 2}") for i, t in enumerate(texts)] * 2 + [(None, "no id", "h9")])
    docs = docs.withColumnRenamed("lang", "n_words").withColumnRenamed("n_chars", "host")
    rows = host_rules.judged(docs).collect()
    assert len(rows) == 2 * len(texts) + 1
    for r in rows:
        want = brute_measures("no id" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r
    kept = host_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert host_rules.judged(documents(spark, [])).count() == 0


def test_bad_hosts_are_rejected_and_small_ones_are_not(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad", "junk") for i in range(90)] + [(i, clean, "junk") for i in range(90, 100)]
    rows += [(1000 + h * 100 + i, clean, f"good{h}") for h in range(8) for i in range(50)]
    rows += [(5000, "bad", "tiny"), (5001, clean, "tiny"), (6000, clean, None)]
    found = {r.doc_id: r for r in host_rules.judged(documents(spark, rows)).collect()}
    assert not found[95].kept and not found[95].base_failed
    assert found[5001].kept and found[6000].kept and all(found[i].kept for i in found if 1000 <= i < 2000)


# Perspective rotation


def test_rotation(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 3, "ann", "bye")]
    turns += [(1, 2, "bob", None), (2, 0, "system", "alone"), (None, None, "eve", "x"), (None, 4, "eve", "first")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS n", "1 AS block")
    found = {(r.conv_id, r.perspective): r for r in chat_rotation.rotated(frame).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "eve")}
    ann = found[1, "ann"]
    assert ann.text == (
        "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n"
        "<|assistant|>\nbye<|end|>\n<|user name=unknown|>\nwho<|end|>\n"
    )
    assert [ann.text[s.start : s.end] for s in ann.mask] == ["hi<|end|>\n", "bye<|end|>\n"]
    assert (ann.n_turns, ann.n_rows) == (5, 6)
    eve = found[None, "eve"]
    assert [eve.text[s.start : s.end] for s in eve.mask] == ["first<|end|>\n", "x<|end|>\n"]
    assert chat_rotation.rotated(frame.limit(0)).count() == 0


def test_long_dialogues_come_in_blocks(spark):
    turns = [(1, 3 * i, f"p{i % 3}", f"text {i} é") for i in range(700)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat_rotation.rotated(frame).where("perspective = 'p1'").orderBy("block").collect()
    assert [r.n_turns for r in rows] == [256, 256, 188]
    learned = [r.text[s.start : s.end] for r in rows for s in r.mask]
    assert learned == [f"text {i} é<|end|>\n" for i in range(1, 700, 3)]
    assert "".join(r.text for r in rows).count("<|end|>") == 700


# Licences

MIT = """The MIT License (MIT)

Copyright (c) 2012 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files, to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all copies or substantial portions.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
 * of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
 * You should have received a copy of the GNU General Public License along with it."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
%sTHIS SOFTWARE IS PROVIDED BY THE AUTHOR "AS IS". IN NO EVENT SHALL THE AUTHOR BE LIABLE."""


@pytest.mark.parametrize(
    ("text", "names", "verdict"),
    [
        ("Text here.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"], "known"),
        ("no stop before\nReleased under the MIT License.\nMore.", ["MIT"], "known"),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "known"),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], "known"),
        (MIT, ["MIT"], "known"),
        (GPL, ["GPL-3.0-or-later"], "known"),
        (BSD % "", ["BSD-2-Clause"], "known"),
        (BSD % "3. Neither the name of X nor of others may be used to endorse or promote products.\n", ["BSD-3-Clause"], "known"),
        ("# SPDX-License-Identifier: BSD-2-Clause", ["bsd-2-clause"], "known"),
        ("It is licensed under strange terms.", [], "unknown"),
        ("Licensed under CC BY-NC 4.0. Also licensed under strange terms.", ["CC-BY-NC-4.0"], "partial"),
        (MIT + "\n\n" + GPL, ["MIT", "GPL-3.0-or-later"], "known"),
        ("A licence to kill. Plain words.", [], "none"),
        (None, [], "none"),
        ("", [], "none"),
    ],
)
def test_licences(spark, text, names, verdict):
    row = license_scan.scanned(documents(spark, [(None, text)])).first()
    assert (row.licenses, row.verdict) == (names, verdict)


def test_licence_scan_of_whole_table_against_plain_search(spark, small):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op8_license_scan(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sorted(r.licenses.split()) == sorted(v for k, v in lines.items() if k in texts[r.doc_id])
    assert license_scan.scanned(documents(spark, [])).count() == 0


def test_every_sentence_rule_has_an_anchor():
    samples = [MIT, GPL, BSD % "3. Neither the name of X may be used to endorse or promote products.\n"]
    for s in (x for t in samples for x in license_scan.sentences(t)):
        assert license_scan.identifier(s) is None or any(a in s for a in license_scan.ANCHORS), s


# A sentence for each sentence rule, in their order.
RULE_SAMPLES = [
    "licensed under the apache license, version 2.0", "distributed under the apache license 2.0",
    "you may not use this file except in compliance with the license", "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing, software distributed under the license",
    "see the license for the specific language governing permissions", "available under the terms of the mit license", "the mit license",
    "permission is hereby granted, free of charge, to any person obtaining a copy",
    "the above copyright notice and this permission notice shall be included in all copies", "the software is provided as is",
    "in no event shall the authors be liable", "permission to use, copy, modify, and/or distribute this software for any purpose",
    "released under the new bsd 3-clause license", "redistribution and use in source and binary forms, with or without modification, are permitted",
    "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice",
    "all advertising materials mentioning features or use of this software must display",
    "neither the name of x may be used to endorse or promote products", "the gnu general public license version 2 or any later version",
    "licensed under the gnu general public license v2",
    "redistribute it and/or modify it under the terms of the gnu general public license as published, either version 3 of it, or any later version",
    "redistribute it and/or modify it under the terms of the gnu general public license version 2",
    "the gnu lesser general public license version 2.1", "licensed under the gnu lesser general public license v2.1",
    "the gnu affero general public license version 3", "distributed in the hope that it will be useful, but without any warranty",
    "you should have received a copy of the gnu general public license", "subject to the terms of the mozilla public license, version 2.0",
    "available under the mozilla public license 2.0", "released under cc by-sa 4.0", "creative commons attribution 4.0",
    "this work is dedicated to the public domain by its author", "this is free and unencumbered software released into the public domain",
    "spdx-license-identifier: mit", "copyright 2020 some one", "all rights reserved", "the license agreement holds",
]


def test_wrapped_and_full_width_sentences_of_every_rule():
    wide = {c: c + 0xFEE0 for c in range(0x21, 0x7F)} | {0x20: 0x3000}
    for (_, pattern), text in zip(license_scan.SENTENCES, RULE_SAMPLES, strict=True):
        assert re.search(pattern, text)
        plain = license_scan.scan(text)
        assert plain[0]
        for other in (text.replace(" ", "\n"), text.replace(" ", "\n# "), text.replace(" ", "\r\n * "), text.replace(" ", "\t  "), text.translate(wide)):
            assert license_scan.scan(other) == plain, other


@pytest.mark.parametrize(
    ("text", "names", "verdict"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["mit", "apache-2.0"], "known"),
        ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0-only-with-classpath-exception-2.0"], "known"),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", ["mit", "apache-2.0"], "known"),
        ("# SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note AND (MIT OR ISC))\nText.", ["gpl-2.0+-with-linux-syscall-note", "mit", "isc"], "known"),
        ("SPDX-License-Identifier: (MIT OR\n  Apache-2.0\n  OR ISC)", ["mit", "apache-2.0", "isc"], "known"),
        ("It is licensed under the MIT License and also released under the Apache License 2.0.", ["MIT", "Apache-2.0"], "known"),
        ("Released under the Apache License 2.0 or licensed under the MIT License", ["Apache-2.0", "MIT"], "known"),
        ("It is licensed under the GNU General Public License, version 2, or any later version.", ["GPL-2.0-or-later"], "known"),
        ("Licensed under the Creative Commons Attribution 4.0 licence.", ["CC-ATTRIBUTION-4.0"], "known"),
        ("Released under the MIT License, the data is licensed under strange terms.", ["MIT"], "partial"),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"], "known"),
        ("Copyright 2020 X, licensed under the MIT License, all rights reserved.", ["MIT"], "known"),
    ],
)
def test_all_licences_of_a_sentence(text, names, verdict):
    _, found, left = license_scan.scan(text)
    assert (found, "partial" if left else "known") == (names, verdict)


def test_identifiers_come_in_order_of_position():
    assert license_scan.identifiers("released under the mit license, provided that the software is provided as is, all rights reserved") == (
        "mit-under", "as-is", "all-rights",
    )


# Pages


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{body}</body></html>"


def extracted(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper")
    return {r.page_id: r for r in html_wrappers.extract(frame).collect()}


def test_whole_pages_table(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op9_html_wrappers(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        plain = html.unescape(re.sub("</?(h1|p|br)>", " ", article).replace("<b>", "").replace("</b>", ""))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


def test_furniture_is_left_out(spark):
    article = "<article><h1>A &amp; B</h1><p>One\n two <b>th</b>ree<br>four<p>five<ul><li>x<li>y</ul><div class='share-box'>share</div></article>"
    body = (
        "<nav>menu</nav><header>site</header><div class='cookie-notice'>ok?</div><aside>side</aside><form>f</form>"
        f"{article}<section id='comments'><article class='comment'>me too</article></section><footer>&copy; x</footer>"
    )
    found = extracted(spark, [("http://a.org/1", page(body)), ("http://a.org/2", page(body.replace("One", "Two")))])
    assert found[0].text == "A & B One two three four five x y" and found[1].text.startswith("A & B Two two")


def test_wrappers_tell_constant_text_without_landmarks(spark):
    pages = [
        ("https://b.org/x", page(f"<div class='top'>Welcome to b</div><div class='z'><h2>h {i}</h2><p>text {i}</p></div><div>contact us</div>"))
        for i in range(5)
    ]
    found = extracted(spark, pages)
    assert [found[i].text for i in range(5)] == [f"h {i} text {i}" for i in range(5)]


def test_odd_pages(spark):
    deep = "<div>" * 3_000 + "deep" + "</div>" * 3_000
    pages = [
        (None, None), ("", ""), ("x", "plain text &lt;b&gt; a < b"), ("http://c.org", "<p>unclosed <b>bold<p>next"), ("http://d.org", page(deep)),
        ("http://e.org", "<script>never closed"), ("http://f.org", "<article>" + "<p>w</p>" * 20_000), ("http://g.org", "<!-- open <p>x</p>"),
        ("http://h.org", "<article></article>"), ("http://h.org", "<article></article>"),
    ]
    found = extracted(spark, pages)
    assert found[0].text == found[1].text == found[5].text == found[7].text == found[8].text == ""
    assert found[2].text == "plain text <b> a < b" and found[3].text == "unclosed bold next" and found[4].text == "deep"
    assert found[6].n_chars == 39_999
    assert html_wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_are_union_free_expressions():
    one = html_wrappers.skeleton(html_wrappers.parse("<article><h2>a</h2><p>x</p><h2>b</h2><p>y</p><p>z</p></article><footer>f</footer>"))
    two = html_wrappers.skeleton(html_wrappers.parse("<article><h2>a</h2><p>x</p></article><table><tr><td>1</table><footer>f</footer>"))
    both = html_wrappers.merge(one, two, 2)
    text = html_wrappers.expression(both)
    assert "(<h2>#text</> (<p>#text</>)+)+" in text and "(<table>" in text and "<footer>#same</>" in text and "|" not in text


def test_wrapper_slots_decide_inside_landmarks(spark):
    notice = "<div class='box'>Read our app</div>"
    pages = [
        ("http://l.org", page(f"<article><h1>head {i}</h1>{notice}<p>{'more text ' * i}own {i}, <i>a</i> and <i>b</i></p><p>middle {i}</p><p>All prices in euro</p></article>"))
        for i in range(6)
    ]
    found = extracted(spark, pages)
    assert [found[i].text for i in range(6)] == [f"head {i} {'more text ' * i}own {i}, a and b middle {i}" for i in range(6)]
    # A part of a block is no furniture, nor is a text that some pages lack.
    links = [
        ("http://m.org", page(f"<main><p>{i} <a class='x'>l{i}</a> and <a class='x'>m{i}</a></p><p>{i}{i} <a class='x'>n</a> and <a class='x'>o{i}</a></p>{'<h2>Sources</h2>' * (i % 2)}</main>"))
        for i in range(8)
    ]
    found = extracted(spark, links)
    assert [found[i].text for i in range(8)] == [f"{i} l{i} and m{i} {i}{i} n and o{i}{' Sources' * (i % 2)}" for i in range(8)]


def test_copies_of_an_article_are_no_furniture(spark):
    for shell in ("<div class='z'>{}</div>", "<article>{}</article>"):
        one = page(shell.format("<h2>Only head</h2><p>only body</p>"))
        assert {r.text for r in extracted(spark, [("http://n.org", one)] * 7).values()} == {"Only head only body"}
        two = page(shell.format("<h2>Other head</h2><p>other body</p>"))
        found = extracted(spark, [("http://n.org", one)] * 7 + [("http://n.org", two)])
        assert {r.text for r in found.values()} == {"Only head only body", "Other head other body"}


@pytest.mark.parametrize("tag", ["div", "span", "b", "font", "div class='x'"])
def test_text_after_deep_elements(spark, tag):
    close = f"</{tag.split()[0]}>"
    deep = f"<{tag}>" * 70 + "deep<nav>menu</nav>" + close * 70
    endless = f"<{tag}>" * 3_000
    found = extracted(spark, [
        ("http://o.org", f"<div><article><p>first</p>{deep}<p>last</p></article></div><p>outside</p>"),
        ("http://p.org", f"<div><article>{endless}in<nav>menu</nav><p>body</p></article></div><p>outside</p>"),
    ])
    assert found[0].text == "first deep last" and found[1].text == "in body"


@pytest.mark.parametrize("n", [2, 3, 7])
def test_labels_that_stand_on_all_pages_stay(spark, n):
    """Equal headings, table headers, terms and captions of different articles are text, however many pages there are."""
    article = (
        "<article><h1>t{0}</h1><h2>Summary</h2><p>body {0}</p><h2>Method</h2><p>more {0}</p>"
        "<table><tr><th>Price</th><th>Size</th></tr><tr><td>{0}</td><td>1</td></tr></table>"
        "<dl><dt>Author</dt><dd>a{0}</dd></dl><figure><figcaption>Figure</figcaption></figure></article>"
    )
    found = extracted(spark, [(f"http://q.org/{i}", page(article.format(i))) for i in range(n)])
    for i in range(n):
        assert found[i].text == f"t{i} Summary body {i} Method more {i} Price Size {i} 1 Author a{i} Figure"


@pytest.mark.parametrize(("name", "text", "stays"), [
    ("notice-theory", "about notices", True), ("social-history", "of a town", True), ("share", "of the market was large", True),
    ("related", "work of others", True), ("ad-slot", "buy now", False), ("notice", "we use cookies", False),
    ("share-buttons", "<a>mail</a> <a>print</a>", False), ("related-posts", "<h3>More</h3><a>one other post</a>", False),
    ("comment-list", "first!", False),
])
def test_names_inside_an_article(spark, name, text, stays):
    found = extracted(spark, [("http://r.org", page(f"<article><p>one</p><section class='{name}'>{text}</section><p>two</p></article>"))])
    assert found[0].text == (f"one {text} two" if stays else "one two")


def test_open_tags_take_linear_time():
    import time

    start = time.perf_counter()
    for text in ("<" + "a" * 10**6, "<a " + "b" * 10**6, "<a '" + "b" * 10**6, "<!--" + "-" * 10**6):
        html_wrappers.parse("<p>x</p>" + text)
    assert time.perf_counter() - start < 4


# Pipeline


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names, and no rows at all."""
    words = "the quick brown fox jumps over a lazy dog and runs along some river bank until night falls on all the hills".split()
    text = " ".join(words)
    other = " ".join(reversed(words))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, other), (5, other), (6, "short")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({"_n": F.lit(77), "_kept": F.lit(88), "kept": F.lit("k"), "component_id": F.lit(1)})
    kept = corpus_pipeline.near_duplicates(spark, odd, "")
    assert kept.columns == odd.columns
    assert {(r._n, r._kept) for r in kept.collect()} == {(77, 88)}
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    ruled = corpus_pipeline.rules(spark, odd, "")
    assert ruled.columns == odd.columns
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
    for name in ("documents", "labels"):
        table = docs.limit(0) if name == "documents" else spark.createDataFrame([], "doc_id long, quality int, toxic int")
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_against_plain_code(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    first = stored(corpus_pipeline.quality(spark, docs, small), "t")
    scores = {r.doc_id: r.predicted for r in quality_classifier.scored(docs, labels).collect()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, p in scores.items() if p)
    bad = labels.where("quality = 0").join(first, "doc_id").count()
    assert bad <= 0.2 * labels.where("quality = 0").count()

    second = stored(corpus_pipeline.rules(spark, first, small), "t")
    texts = {r.doc_id: r.text for r in first.collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, t in texts.items() if not brute_measures(t)[-1])

    from test_near_dup import brute_components

    third = stored(corpus_pipeline.near_duplicates(spark, second, small), "t")
    groups = brute_components([(r.doc_id, r.text) for r in second.collect()], corpus_pipeline.SIMILAR)
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert first.columns == second.columns == third.columns == docs.columns

    from test_encoding import check_packing

    from hazardflow.llm.encoding import PieceEncoder, vocabulary

    encoder = PieceEncoder(vocabulary("byte_bpe_50k.json"))
    lengths = {r.doc_id: len(encoder.encode([r.text])[0]) // 4 + 1 for r in third.collect()}
    check_packing(corpus_pipeline.pack(spark, third, small).collect(), lengths, 2048)


def test_pipeline_runs_from_end_to_end(spark, small):
    rows = entry.queries()["pipeline"](spark, small)
    assert rows.count() > 100 and "sequence_id" in rows.columns
