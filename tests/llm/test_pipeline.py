"""The pipeline's stages on a small table: what goes, what stays, what changes."""

import os
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from saleslens.llm import byte_pairs, toxicity, words

from test_cleaning_operators import components, prose, vocabulary

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    draw, vocab = random.Random(1), vocabulary(n=2000)
    items = [(i, prose(draw, vocab, 30)) for i in range(5)]
    texts = {i: prose(draw, vocab, draw.randint(20, 200)) for i in range(600)}
    toxic = set(range(0, 600, 4))
    for i in toxic:
        texts[i] += " you idiot"
    texts[1001], texts[1002] = texts[1], texts[2] + " more"
    texts[1003] = f"{texts[3]} {items[2][1]}"
    texts[1005] = f"{texts[5]} ann@example.com"
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in texts.items()] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    tables = {
        "documents": spark.createDataFrame(rows, SCHEMA),
        "labels": spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), rows, toxic


def staged(spark, corpus):
    folder, _, _ = corpus
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        found.append({r.doc_id: r for r in docs.collect()})
    return found


def test_each_stage(spark, corpus):
    _, rows, toxic = corpus
    clean, single, unleaked, sanitised, tokens = staged(spark, corpus)
    texts = {r[0]: r[1] for r in rows}
    left = set(texts) - set(clean)
    assert left <= toxic and len(left) > 0.95 * len(toxic)
    expected, _ = components([(i, texts[i]) for i in clean], 5, 80)
    assert set(single) == {i for i in clean if expected[i] == i} and {1001, 1002} <= set(clean) - set(single)
    assert set(unleaked) == set(single) - {1003}
    assert set(sanitised) == set(unleaked) == set(tokens)
    changed = [i for i in sanitised if sanitised[i] != unleaked[i]]
    assert changed == [] or set(changed) == {1005}
    for i in set(sanitised) - {1005}:
        assert tuple(sanitised[i]) == next(r for r in rows if r[0] == i)
    assert tokens[2000].n_tokens == tokens[2001].n_tokens == 0 and all(r.round_trip for r in tokens.values())


def test_personal_data_goes(spark):
    docs = spark.createDataFrame([(1, "write to ann@example.com", "en", "s", 24)], SCHEMA)
    row = corpus_pipeline.without_personal_data(spark, docs, FOLDER).first()
    assert tuple(row) == (1, "write to [EMAIL]", "en", "s", 16)


def test_run_equals_its_stages(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert {r.doc_id: r for r in rows} == staged(spark, corpus)[-1]


def test_stages_take_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, corpus[0])
        assert docs.count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no given tables")
def test_registered(spark):
    names = registered.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert names["pipeline"](spark, FOLDER).count() > 0


def test_a_task_gives_back_what_it_has_freed():
    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    pinned = []

    def work(batches):
        blocks = [np.ones(8000) for _ in range(4000)]  # 256 MB in blocks that malloc keeps
        pinned.append(np.ones(8000))  # above them, so that they can't be cut off at the end
        del blocks
        for batch in batches:
            during.append(held())
            yield batch

    during, batch = [], pa.record_batch([pa.array([1])], names=["x"])
    assert list(words.giving_back(work)(iter([batch, batch]))) == [batch, batch]
    assert held() < during[-1] - 200_000_000 and len(pinned) == 1


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_encoding_holds_a_string_for_each_distinct_piece():
    with open(byte_pairs.installed_vocabulary(), encoding="utf-8") as file:
        coder = byte_pairs.PairIndexCoder(byte_pairs.read_vocabulary(file.read()))
    texts = [" lorem ipsum" * 250] * 600  # 300,000 pieces in one batch

    def work():
        assert len({joined for joined in coder.encode(texts)}) == 1

    assert peak_mb(work) < 10


def test_weights_are_worked_out_in_slices(monkeypatch):
    examples, labels = [np.array([3, 70_000]), np.array([3, 1_048_575])] * 20, np.array([1, 0] * 20)
    found = []
    assert peak_mb(lambda: found.append(toxicity.fit(examples, labels, toxicity.FtrlRule(l1=0.1)))) < 45
    monkeypatch.setattr(toxicity, "SLICE", 1 << 21)  # all at once
    whole, bias = toxicity.fit(examples, labels, toxicity.FtrlRule(l1=0.1))
    assert (found[0][0] == whole).all() and found[0][1] == bias and (whole != 0).sum() == 3
