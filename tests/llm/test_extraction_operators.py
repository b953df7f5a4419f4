"""Resharding, licences, page texts, byte pairs, top products, URL verdicts: against brute force and SQL."""

import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from compare import database, differences
from saleslens.llm import byte_pairs, components, licenses, resharding, site_trees, top_products, url_filter

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no given tables")


@given
@pytest.mark.parametrize("name", ["op4_licence_sentences", "op8_norm_buckets", "op9_redirect_equivalence"])
def test_query_equals_its_sql(spark, name):
    assert differences(registered.queries()[name](spark, FOLDER), database(FOLDER), registered.oracle_sql()[name]) is None


# components


def test_components_of_long_paths_and_stars(frame):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 3), (3, 7), (3, 3), (9, 9)]
    draw.shuffle(edges)
    found = {r.node: r.component for r in components.connected_components(frame(edges, "a long, b long"), "a", "b").collect()}
    expected = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {3: 3, 7: 3}
    assert found == expected
    assert components.connected_components(frame([], "a long, b long"), "a", "b").count() == 0


# resharding


def fewest_moves(sizes, capacities):
    return sum(sizes.values()) - sum(min(size, capacities.get(shard, 0)) for shard, size in sizes.items())


def test_transfers_move_the_fewest_bytes():
    draw = random.Random(2)
    for _ in range(200):
        sizes = {i: draw.randint(0, 30) for i in draw.sample(range(10), draw.randint(0, 8))}
        capacities = {i: draw.randint(0, 30) for i in draw.sample(range(10), draw.randint(1, 8))}
        if sum(capacities.values()) < sum(sizes.values()):
            with pytest.raises(ValueError):
                resharding.solve_transfers(sizes, capacities)
            continue
        found = resharding.solve_transfers(sizes, capacities)
        for shard, size in sizes.items():
            assert sum(t.size for t in found if t.source == shard) == size
        for shard, room in capacities.items():
            assert sum(t.size for t in found if t.target == shard) <= room
        assert sum(t.size for t in found if t.source != t.target) == fewest_moves(sizes, capacities)


def test_reshard_places_every_row(frame):
    draw = random.Random(3)
    rows = [(i, "é" * draw.randint(0, 200), draw.choice([0, 0, 0, 1, 2, 19, None])) for i in range(3000)]
    rows += [(None, None, 5), (1, "dup", 5), (1, "dup", 5), (2, "", None)]
    docs = frame(rows, "doc_id long, text string, shard int")
    found = resharding.reshard(docs, F.col("shard")).collect()
    key = lambda i, t: (i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in found) == sorted(key(i, t) for i, t, _ in rows)
    total = sum(r.size for r in found)
    for shard in range(16):
        own = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= max(r.size for r in found)
    old = {}
    for r in found:
        old[r.old_shard] = old.get(r.old_shard, 0) + r.size
    moved = sum(r.size for r in found if r.shard != r.old_shard)
    assert moved <= fewest_moves(old, resharding.equal_capacities(total, 16)) * 1.01 + 4000


def test_reshard_of_few_rows(frame):
    docs = frame([(1, "x")], "doc_id long, text string")
    assert [tuple(r) for r in resharding.reshard(docs, F.lit(3)).select("doc_id", "size", "slot").collect()] == [(1, 2, 0)]
    assert resharding.reshard(docs.limit(0), F.lit(3)).count() == 0


def test_only_affected_shards_are_rewritten(spark, frame, tmp_path):
    rows = [(i, "x" * 9, i % 4, "kept") for i in range(400)] + [(1000 + i, "y" * 9, 0, "kept") for i in range(40)]
    docs = frame(rows, "doc_id long, text string, shard int, more string")
    folder = str(tmp_path / "shards")
    docs.write.partitionBy("shard").parquet(folder)
    capacities = resharding.ReshardRule(shards=4)
    plan = resharding.reshard(docs, F.col("shard"), capacities)
    before = {f for f in Path(folder).rglob("*.parquet")}
    affected = resharding.rewrite_affected(docs, plan, folder)
    assert affected == [0, 1, 2, 3]
    stored = spark.read.parquet(folder)
    assert sorted(r.doc_id for r in stored.collect()) == sorted(r[0] for r in rows)
    assert {r["count"] for r in stored.groupBy("shard").count().collect()} == {110}
    assert stored.columns == ["doc_id", "text", "more", "shard"] and not before & set(Path(folder).rglob("*.parquet"))
    again = resharding.reshard(stored, F.col("shard"), capacities)
    files = set(Path(folder).rglob("*.parquet"))
    assert resharding.rewrite_affected(stored, again, folder) == [] and files == set(Path(folder).rglob("*.parquet"))


# licences


def test_every_pattern_holds_a_hint():
    for _, pattern in licenses.SENTENCES:
        plain = re.sub(r"\[cs\]", "s", pattern)
        assert re.search(licenses.HINT, plain), pattern


def test_sequences_of_sentences_name_the_licence(frame):
    mit = (
        "MIT License\n\nCopyright (c) 2020 Ann\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
        "The above copyright notice and this permission notice shall be included in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. In no event shall the authors or copyright holders be liable.'
    )
    rows = [
        (1, mit),
        (2, "Words. Licensed under the Apache License, Version 2.0. Words.\nReleased under the MIT License."),
        (3, "You may not use this file except in compliance with the License."),
        (4, "SPDX-License-Identifier: MIT"),
        (5, None),
        (6, ""),
        (7, "no such thing " * 1000),
        (8, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    found = {r.doc_id: r for r in licenses.recognise(frame(rows, "doc_id long, text string")).collect()}
    assert found[1].licences == ["MIT"] and found[1].unmatched_ids == []
    assert found[1].sentence_ids == ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]
    assert found[2].licences == ["Apache-2.0", "MIT"]
    assert found[3].licences == [] and found[3].unmatched_ids == ["apache-2-use"]
    assert found[4].licences == ["MIT"] and found[8].licences == ["CC-BY-NC-4.0", "GPL-3.0"]
    assert all(found[i].sentence_ids == [] == found[i].licences for i in (5, 6, 7))
    clashing = frame([(1, "x", "y")], "doc_id long, text string, licences string")
    assert licenses.recognise(clashing).first().licences == []
    assert licenses.recognise(clashing.limit(0)).count() == 0


WRAPPED_MIT = """Copyright (c) 2020 Ann

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
WRAPPED_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
WRAPPED_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES."""
WRAPPED_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_texts_name_the_licence(frame, sign):
    texts = [
        WRAPPED_MIT, "MIT License\n\n" + WRAPPED_MIT, WRAPPED_GPL, WRAPPED_BSD, WRAPPED_APACHE,
        "This is free and unencumbered software released into\nthe public domain.",
        "Released under the MIT License\nLicensed under the BSD\n2-Clause License",
        "Released under the MIT\n\nLicense",
    ]
    rows = [(i, "int a;\n" + "\n".join(sign + line for line in text.split("\n")).replace("\n", "\r\n" if i % 2 else "\n")) for i, text in enumerate(texts)]
    found = {r.doc_id: r for r in licenses.recognise(frame(rows, "doc_id long, text string")).collect()}
    mit = ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]
    assert found[0].sentence_ids == mit and found[1].sentence_ids == ["mit-title", *mit]
    assert found[2].sentence_ids == ["gpl-3-later", "gpl-hope", "gpl-details", "gpl-copy"]
    assert found[3].sentence_ids == ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]
    assert found[4].sentence_ids == ["apache-2", "apache-2-use", "apache-2-copy", "apache-2-basis", "apache-2-limits"]
    named = [["MIT"], ["MIT"], ["GPL-3.0-or-later"], ["BSD-3-Clause"], ["Apache-2.0"], ["Unlicense"], ["BSD-2-Clause", "MIT"], []]
    assert [found[i].licences for i in range(8)] == named and all(found[i].unmatched_ids == [] for i in range(8))


# page texts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">Cookies!</div>
<!-- ad <p>no</p> --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One
 two<br>three<p>caf&eacute; &#x41;&nbsp;B</p><aside>side</aside><form><label>Name</label><input></form><ul><li>first<li>second</ul>
<section class="comments"><p>reader</p></section></article><footer>&copy; me</footer>"""


def page_texts(frame, rows):
    return {r.page_id: r for r in site_trees.extract_text(frame(rows, "page_id long, url string, html string")).collect()}


def test_marked_article(frame):
    found = page_texts(frame, [(1, "http://a.b/c", PAGE), (2, "http://a.b/d", None), (3, None, ""), (4, "x", "plain &lt;text")])
    assert found[1].text == "Head & line\nOne two three\ncafé A B\nfirst\nsecond" and found[1].n_chars == len(found[1].text)
    assert (found[2].text, found[3].text, found[4].text) == ("", "", "plain <text")


def test_names_tell_what_a_branch_is(frame):
    html = (
        '<body class="has-sidebar"><div class="wrap with-sidebar"><div id="top-nav">no</div><article class="post"><p>yes</p>'
        '<div class="share-bar">no</div></article><article class="comment">no</article><div class="related"><article>no</article></div></div>'
    )
    assert page_texts(frame, [(1, "http://a.b/c", html)])[1].text == "yes"


def test_copied_articles_are_kept_whole(frame):
    found = page_texts(frame, [(i, "http://a.b/c", PAGE) for i in range(20)])
    assert {r.text for r in found.values()} == {"Head & line\nOne two three\ncafé A B\nfirst\nsecond"}


def test_copies_of_unmarked_pages_are_kept_whole(frame):
    html = "<body><div class=top>Same line</div><div class=body><p>Own words {0}</p></div></body>"
    rows = [(i, f"http://a.b/{i}", html.format("x")) for i in range(100)]  # all alike
    rows += [(1000 + i, f"http://c.d/{i}", html.format(max(i - 90, 0))) for i in range(100)]  # nine in ten alike
    found = page_texts(frame, rows)
    assert {found[i].text for i in range(100)} == {"Same line\nOwn words x"}
    assert all(found[1000 + i].text == f"Own words {max(i - 90, 0)}" for i in range(100))


def test_repeated_branches_of_unmarked_pages_go(frame):
    html = "<body><div class=top>Same <b>line</b></div><ul><li><a href=x>to {0}</a><li><a>and {0}</a></ul><div class=body><p>Own words {0}</p><p>and more {0}</p></div><div class=end>Same end</div>"
    rows = [(i, f"http://One.b/{i}", html.format(i)) for i in range(12)] + [(100, "http://two.b/", html.format("x"))]
    found = page_texts(frame, rows)
    assert all(found[i].text == f"Own words {i}\nand more {i}" for i in range(12))
    assert found[100].text == "Same line\nOwn words x\nand more x\nSame end"  # one page says nothing about its site
    nodes = {(r.host, r.path): r for r in site_trees.style_nodes(frame(rows, "page_id long, url string, html string")).collect()}
    assert nodes["one.b", "/body/div.top"].importance == pytest.approx(0) and nodes["one.b", "/body/div.top"].pages == 12
    assert nodes["one.b", "/body/div.body/p"].importance == pytest.approx(1)
    assert not any(host == "two.b" for host, _ in nodes)


def test_importance_is_the_entropy(frame):
    rows = [(i, "http://a.b/", f"<body><div class=x>{'same' if i < 6 else i}</div>") for i in range(8)]
    nodes = {r.path: r.importance for r in site_trees.style_nodes(frame(rows, "page_id long, url string, html string")).collect()}
    shares = [6 / 8, 1 / 8, 1 / 8]
    assert nodes["/body/div.x"] == pytest.approx(-sum(p * np.log(p) for p in shares) / np.log(8))


def test_pages_of_odd_tables(frame):
    odd = frame([(1, "u", "<p>x" * 20_000, "clash", 5)], "page_id long, url string, html string, text string, host int")
    row = site_trees.extract_text(odd).first()
    assert row.text == "\n".join(["x"] * 20_000) and row.host == 5
    assert site_trees.extract_text(odd.limit(0)).count() == 0


# byte pairs

TEXTS = [
    None, "", " ", "aaaa aaaaaaa", "<|endoftext|>a<|endoftext|> <|endoftext|", "I'll we've 'S 's", "x\x1c\x1d y\x85z  q　", "½²Ⅷ٣ a×b÷c á _ __x",
    "é́🙂🙂‍ x y", "\r\n\r\n  \t a", "a" * 3000, "ab" * 3000, "Ünï\x00\x01 %$ 12345 1,234.5", " " * 50 + "x", "中文字符 ひらがな 한국어", "The quick brown fox. " * 2000,
]


def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(byte_pairs.installed_vocabulary())


def test_ids_and_decoding_equal_the_library(frame, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BATCH_CHARACTERS", 5000)
    tokenizer = library()
    draw = random.Random(4)
    signs = "aab  'sté🙂\n12-_<|endoftext|>中"
    texts = TEXTS + ["".join(draw.choice(signs) for _ in range(draw.randint(1, 80))) for _ in range(300)]
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_pairs.encode_documents(docs, byte_pairs.installed_vocabulary()).collect():
        ids = tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.token_ids == ",".join(map(str, ids)) and row.n_tokens == len(ids)
        assert row.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_digests_and_odd_tables(frame):
    docs = frame([(1, "ab", 7), (1, "ab", 7), (None, None, None)], "doc_id long, text string, n_tokens int")
    rows = byte_pairs.token_digests(docs, byte_pairs.installed_vocabulary()).collect()
    assert len(rows) == 3 and len({r.ids_sha256 for r in rows if r.doc_id}) == 1
    assert {r.n_tokens for r in rows if r.doc_id is None} == {0}
    assert byte_pairs.token_digests(docs.limit(0), byte_pairs.installed_vocabulary()).count() == 0


def coder():
    with open(byte_pairs.installed_vocabulary(), encoding="utf-8") as file:
        return byte_pairs.PairIndexCoder(byte_pairs.read_vocabulary(file.read()))


def test_new_words_are_merged_side_by_side(monkeypatch):
    draw = random.Random(6)
    words = ["".join(draw.choice("etaoinsé") for _ in range(draw.randint(2, 12))) for _ in range(3000)]
    found, steps = coder(), []
    ranks = found._ranks
    monkeypatch.setattr(found, "_ranks", lambda *pairs: steps.append(1) or ranks(*pairs))
    assert list(found.encode([" ".join(words)])) == [",".join(map(str, library().encode(" ".join(words), add_special_tokens=False).ids))]
    assert len(steps) < 40  # a step for every rank that occurs, hundreds of them, before


@pytest.mark.parametrize("short, side_by_side", [(0, 1), (3, 7), (128, 129), (1 << 20, 1 << 20)])
def test_short_and_long_pieces_agree(monkeypatch, short, side_by_side):
    texts = [t or "" for t in TEXTS] + ["".join(random.Random(i).choices("aab", k=i)) for i in (127, 128, 129, 400)]
    expected = [",".join(map(str, library().encode(t, add_special_tokens=False).ids)) for t in texts]
    monkeypatch.setattr(byte_pairs, "SHORT_PIECE", short)
    monkeypatch.setattr(byte_pairs, "SIDE_BY_SIDE", side_by_side)
    monkeypatch.setattr(byte_pairs, "SLICE", 5)
    monkeypatch.setattr(byte_pairs, "REMEMBERED_PIECES", 10)
    assert list(coder().encode(texts)) == expected and list(coder().encode(texts[::-1])) == expected[::-1]


# top products


def brute_force(rows, every, k):
    usable = {i: np.floor(64.0 * np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in usable:
        if q % every == 0:
            scored = sorted((-int(usable[q] @ usable[c]), c) for c in usable if c != q)[:k]
            expected += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scored)]
    return sorted(expected)


@pytest.mark.parametrize("rule", [
    top_products.TopRule(),
    top_products.TopRule(k=3, bucket_bytes=2000, query_bytes=1500, slice_buckets=2, coordinate_from=-1.0),
    top_products.TopRule(k=7, bucket_bytes=2000, query_bytes=1500, slice_buckets=1, coordinate_from=2.0),
])
def test_top_products_equal_all_products(frame, rule):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=8) * draw.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # many equal vectors
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [0.0] * 8), (None, [1.0] * 8)]
    vectors = top_products.whole_vectors(frame(rows, "vec_id long, v array<double>"), "vec_id", "v", 64.0)
    found = top_products.top_products(vectors.filter("id % 20 = 0"), vectors, rule).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_force(rows, 20, rule.k)


def test_top_products_of_few_and_large_vectors(frame):
    vectors = top_products.whole_vectors(frame([(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [-1.0, 3.0])], "i long, v array<double>"), "i", "v", 64.0)
    found = [tuple(r) for r in top_products.top_products(vectors.filter("id = 0"), vectors).collect()]
    assert sorted(found) == [(0, 1, 1, 640000000**2 + 64 * 128), (0, 2, 2, -640000000 * 64 + 64 * 192)]
    assert top_products.top_products(vectors.limit(0), vectors).count() == 0
    assert top_products.top_products(vectors, vectors.limit(0)).count() == 0


# URL verdicts


def verdicts(frame, rows, **more):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame(rows, "page_id long, url string, html string"), **more).collect()}


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head>'


def test_rules_by_host_and_path(frame):
    found = verdicts(frame, [
        (1, "http://A.Example.NET/de/1?x#y", None), (2, "http://example.net/en/1", ""), (3, "http://notexample.com/de/", "x"),
        (4, "https://www.example.com/de/2", None), (5, "http://x.org/fr/", None), (6, None, None), (7, "no scheme", None), (8, "", None),
        (9, "http://b.net", None), (10, "http://b.net?q=/", None),
    ])
    assert found[1] == ("a.example.net", "/de/1", "net/", "block") and found[2] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert found[3] == ("notexample.com", "/de/", None, "allow") and found[4][2:] == ("example.com/de/", "block")
    assert found[5][2:] == ("org/fr/", "allow")
    assert found[6] == found[7] == found[8] == ("", "", None, "allow")
    assert found[9] == ("b.net", "", None, "allow") and found[10] == ("b.net", "", None, "allow")


def test_blocks_reach_aliases_unless_one_is_allowed(frame):
    rows = [
        (1, "http://one.com/a", canonical("http://bad.net/x")),
        (2, "https://ONE.com/a#part", None),  # the same resource
        (3, "http://two.com/", '<meta http-equiv="refresh" content="0; url=http://one.com/a">'),
        (4, "http://three.com/p/q", canonical("/r")),
        (5, "http://three.com/r", canonical("//bad.net/y")),
        (6, "http://four.com/", canonical("http://bad.net/z")),
        (7, "http://ok.org/fr/1", canonical("http://four.com/")),  # allowed, and so are its aliases
        (8, "http://five.com/", "<!-- " + canonical("http://bad.net/") + " -->"),
        (9, "http://six.com/", canonical("http://seven.com/?a=1&amp;b=2")),
        (10, "http://seven.com/?a=1&b=2", None),
    ]
    found = {i: v[3] for i, v in verdicts(frame, rows).items()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    redirects = frame([("http://seven.com/?a=1&b=2", "http://bad.net/"), (None, "http://x"), ("http://x", None)], "source string, target string")
    found = {i: v[3] for i, v in verdicts(frame, rows, redirects=redirects).items()}
    assert found[9] == found[10] == "block"


def test_aliases_equal_their_sql(spark, frame, tmp_path):
    draw = random.Random(6)
    urls = [f"http://{draw.choice('abc')}{i}.{draw.choice(['com', 'net', 'org', 'example.com'])}/{draw.choice(['fr', 'de', 'x'])}/{i}" for i in range(60)]
    rows = [(i, u, canonical(draw.choice(urls)) if i % 2 else None) for i, u in enumerate(urls)] + [(100, urls[1], canonical(urls[5])), (101, None, "x")]
    frame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    query = registered.queries()["op9_redirect_equivalence"](spark, str(tmp_path))
    assert differences(query, connection, registered.oracle_sql()["op9_redirect_equivalence"]) is None


def test_too_many_rules():
    rules = tuple(url_filter.Rule("block", f"h{i}", "/") for i in range(url_filter.MOST_RULES + 1))
    with pytest.raises(ValueError):
        url_filter.matching_rule(F.lit("x"), F.lit("/"), rules, "name")
    assert len(list(itertools.islice(rules, 3))) == 3
