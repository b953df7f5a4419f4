"""Cases that once gave wrong results: colliding words, clashing columns, parts of articles."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import differences
from saleslens.llm import decontamination, licenses, near_copies, personal_data, queries, site_trees, url_filter, words


def test_words_that_collide_under_polynomials(frame):
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    (_, counts, hashes), *_ = words.words_of(pa.array([f"{morse} {other} {morse.upper()}"]), words.WHITE_SPACE)
    assert counts.tolist() == [3] and hashes[0] != hashes[1] and hashes[0] == hashes[2]
    rule = near_copies.NearCopyRule(words=3, percent=85, bands=32)
    found = near_copies.near_copies(frame([(1, morse), (2, other)], "doc_id long, text string"), rule)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2}


PAGES = "page_id long, url string, html string, _low string, _host string, _own string, _resource string, _alias string, host_ int"


def test_no_column_of_the_pages_clashes(frame):
    rows = [(i, f"http://h.example.net/{i}", f"<article><p>text {i}</p></article>", "l", "h", "o", "r", "a", 1) for i in range(8)]
    df = frame(rows, PAGES)
    found = site_trees.extract_text(df)
    assert found.columns == [*df.columns, "text", "n_chars"]
    assert {r.page_id: (r.text, r["_low"], r["_host"]) for r in found.collect()} == {i: (f"text {i}", "l", "h") for i in range(8)}
    judged = url_filter.judge(df)
    assert set(df.columns) < set(judged.columns)
    assert {(r["_own"], r["_resource"], r["_alias"], r.verdict) for r in judged.collect()} == {("o", "r", "a", "block")}


def test_no_column_of_the_documents_clashes(frame):
    schema = "doc_id long, text string, _dropped string, _email string, _ip string, _key long, _all string, others int, c0 int"
    rows = [(1, "ann@example.com said so to all of us here", "d", "e", "i", 5, "a", 1, 2), (2, "nothing here", "d", "e", "i", 6, "a", 1, 2)]
    df = frame(rows, schema)
    found = personal_data.find_personal_data(df)
    assert found.columns == [*df.columns, "spans", "sanitised"]
    for r in found.collect():
        assert tuple(r)[: len(df.columns)] == rows[r.doc_id - 1] and (r.sanitised != r.text) == (r.doc_id == 1)
    assert near_copies.drop_near_copies(df).count() == 2


# parts of a marked article


def site(make, n=12):
    return [(i, f"http://s.example.org/{i}", make(i)) for i in range(n)]


def texts(frame, rows):
    return [r.text for r in site_trees.extract_text(frame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_what_all_pages_share_leaves_the_article(frame):
    rows = site(lambda i: f"<main><p>Story {i} is long enough to be the article.</p><div class='legal'>All rights kept.</div></main>")
    assert texts(frame, rows) == [f"Story {i} is long enough to be the article." for i in range(12)]


def test_a_section_is_not_dropped_for_its_name(frame):
    rows = site(lambda i: f"<main><p>Story {i}.</p><section class='share'>The share rose by {i} points.</section></main>")
    assert texts(frame, rows) == [f"Story {i}.\nThe share rose by {i} points." for i in range(12)]
    assert texts(frame, rows[:1]) == ["Story 0.\nThe share rose by 0 points."]


def test_share_buttons_go(frame):
    button = "<div class='share'>Share this</div><div class='social'><a href='x'>Post {0}</a></div>"
    rows = site(lambda i: f"<main><p>Story {i} goes on and on.</p>{button.format(i)}</main>")
    assert texts(frame, rows) == [f"Story {i} goes on and on." for i in range(12)]


def test_reader_comments_and_adverts_go_whatever_their_texts(frame):
    rows = site(lambda i: f"<article><p>Story {i}.</p><div class='comments'>I like {i}</div><div class='ad'>Buy {i}</div></article>")
    assert texts(frame, rows) == [f"Story {i}." for i in range(12)]


def test_an_article_on_many_pages_stays(frame):
    rows = site(lambda i: f"<nav>menu {i}</nav><article><h1>Same</h1><p>The same story on each page.</p></article>")
    assert set(texts(frame, rows)) == {"Same\nThe same story on each page."}


@pytest.mark.parametrize("open_importance, kept", [(0.6, True), (1.1, False)])
def test_importance_decides_on_open_words(frame, open_importance, kept):
    rows = site(lambda i: f"<main><p>A story told at length, number {i}.</p><section class='share'>Up by {i}.</section></main>")
    rule = site_trees.TreeRule(open_importance=open_importance)
    found = site_trees.extract_text(frame(rows, "page_id long, url string, html string"), rule).collect()
    assert all(("Up by" in r.text) == kept for r in found)


# licences

LICENCES = {
    "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"],
    "// SPDX-License-Identifier: GPL-3.0-only": ["GPL-3.0-only"],
    "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
    "# SPDX-License-Identifier: (MIT AND BSD-3-Clause)\ncode": ["BSD-3-Clause", "MIT"],
    "/* SPDX-License-Identifier: ((LGPL-2.1+ WITH Classpath-exception-2.0) OR mit) */": ["LGPL-2.1-or-later WITH Classpath-exception-2.0", "MIT"],
    "SPDX-License-Identifier: LicenseRef-own OR Foo-9": ["LicenseRef-own"],
    "SPDX-License-Identifier: Apache-2.0. And more": ["Apache-2.0"],
    "SPDX-License-Identifier: mit and more words": ["MIT"],
    "SPDX-License-Identifier:": [],
    "licensed under the MIT License and the docs are licensed under CC BY 4.0": ["CC-BY-4.0", "MIT"],
    "Dual licensed under the MIT license or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
    "code released into the public domain, data released under CC0 1.0": ["CC0-1.0", "LicenseRef-Public-Domain"],
    "you may do what you like": [],
}


def test_licences_of_expressions_and_mixed_sentences(spark, frame, tmp_path):
    rows = [*enumerate(LICENCES), (100, None), (101, ""), (102, "x\n" * 20_000 + "SPDX-License-Identifier: ISC")]
    frame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = frame(rows, "doc_id long, text string").withColumn("_marked", F.lit("kept"))
    found = {r.doc_id: r for r in licenses.recognise(docs).collect()}
    assert {t: found[i].licences for i, t in enumerate(LICENCES)} == LICENCES
    assert found[100].licences == found[101].licences == [] and found[102].licences == ["ISC"] and found[0]["_marked"] == "kept"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(queries.licences(spark, str(tmp_path)), connection, queries.SQL["op4_licence_sentences"]) is None


# benchmark leaks


def test_items_of_one_and_two_words(frame):
    items = frame([(1, "what is"), (2, "Yes!"), (3, "  "), (4, "what is"), (5, "one two three")], "item_id long, text string")
    docs = frame([(1, "What is?"), (2, "yes"), (3, "what is this"), (4, "no"), (5, ""), (6, None), (7, "is what")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.score, r.item_words, r.last_word) for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {(1, 1, 2, 2, 1), (1, 4, 2, 2, 1), (2, 2, 1, 1, 0)}
    assert {r.doc_id for r in decontamination.drop_leaks(docs, items).collect()} == {3, 4, 5, 6, 7}


def test_many_spans_in_one_text_keep_their_places(frame):
    words = [f"user{i}@h{i % 7}.example" if i % 3 else "1.2.3.4 \U0001f600" for i in range(6_000)]
    text = "é " + " ".join(words) + " " + "long" * 2_000
    row = personal_data.find_personal_data(frame([(1, text)], "doc_id long, text string")).first()
    assert len(row.spans) == 6_000 and all(text[s.start : s.end] == s.value for s in row.spans)
    expected = "é " + " ".join("[EMAIL]" if i % 3 else "[IP] \U0001f600" for i in range(6_000)) + " " + "long" * 2_000
    assert row.sanitised == expected
