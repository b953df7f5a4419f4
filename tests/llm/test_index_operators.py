"""Near copies of vectors, Merkle manifest, periodic runs: against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from saleslens.llm import merkle_manifest, periodic_runs, vector_copies, words
from saleslens.llm.queries import with_planted_runs

FOLDER = "/root/testdata/sf0.001"


def test_sizes_are_read_as_spark_spells_them(spark):
    assert [words.byte_count(s) for s in ("7", "8b", "64k", "64m", "1GB", " 2mb ")] == [7, 8, 65536, 64 << 20, 1 << 30, 2 << 20]
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64m")
    words.bound_batches(spark)
    assert spark.conf.get(setting) == f"{words.BATCH_BYTES}b"
    spark.conf.set(setting, before)


# near copies of vectors


def linked(rows, least=0.95):
    """Rows of (key, number of links, component, kept), all pairs compared."""
    usable = [
        i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    links, label = defaultdict(set), {i: i for i in range(len(rows))}
    units = {i: np.array(rows[i][1], float) / np.abs(np.array(rows[i][1], float)).max() for i in usable}
    units = {i: u / np.linalg.norm(u) for i, u in units.items()}
    for i in usable:
        for j in usable:
            if i != j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i].add(j)
    changed = True
    while changed:
        changed = False
        for i in usable:
            for j in links[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    keys = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            keys[label[i]].append(key)
    found = []
    for i, (key, _) in enumerate(rows):
        component = min(keys[label[i]], default=None)
        found.append((key, len(links[i]), component, key is not None and key == component))
    return sorted(found, key=repr)


def judged(df, **kw):
    return sorted((tuple(r) for r in vector_copies.vector_copies(df, **kw).collect()), key=repr)


def around(draw, centre, cosine):
    aside = draw.standard_normal(len(centre))
    aside -= (aside @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)


def directions(draw, n, size):
    v = draw.standard_normal((n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_links_at_and_around_the_threshold(frame):
    draw = np.random.default_rng(1)
    rows, seeds = [], directions(draw, 250, 32)
    for i, seed in enumerate(seeds):
        rows.append((10 * i, seed))
        for k, cosine in enumerate((0.999, 0.97, 0.951, 0.949, 0.9)):
            rows.append((10 * i + k + 1, 3.7 * around(draw, seed, cosine)))
    rows = [(key, v.tolist()) for key, v in rows]
    got = {r[0]: r for r in judged(frame(rows, "vec_id long, embedding array<double>"))}
    want = {r[0]: r for r in linked(rows)}
    assert sum(r[1] for r in got.values()) >= 0.98 * sum(r[1] for r in want.values())
    assert all(got[key][1] <= want[key][1] for key in want)
    assert sum(got[key] == want[key] for key in want) >= 0.97 * len(want)


def test_vectors_in_a_narrow_cone_are_found_too(frame):
    draw = np.random.default_rng(2)
    cone = directions(draw, 300, 24) * 0.35 + directions(draw, 1, 24)
    cone /= np.linalg.norm(cone, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(cone)]
    rows += [(1000 + i, around(draw, v, 0.96).tolist()) for i, v in enumerate(cone[:100])]
    got, want = judged(frame(rows, "vec_id long, embedding array<float>")), linked(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want) > 0


def test_a_dense_spot_writes_few_pairs(frame, monkeypatch):
    draw = np.random.default_rng(3)
    centre = directions(draw, 1, 32)[0]
    rows = [(i, around(draw, centre, 0.992).tolist()) for i in range(600)]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(directions(draw, 600, 32))]
    written, candidates = [], vector_copies._candidates
    monkeypatch.setattr(vector_copies, "_candidates", lambda *a: written.append(candidates(*a)) or written[-1])
    assert judged(frame(rows, "vec_id long, embedding array<double>")) == linked(rows)
    assert written[0].count() < 600 * 599 / 2 / 4


def test_edges_of_vectors(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None),
        (2, []),
        (3, [0.0, -0.0]),
        (4, [1.0, None]),
        (5, [1.0, nan]),
        (6, [1.0, -inf]),
        (7, [1.0, 0.0]),
        (8, [1e300, 1e290]),
        (9, [1e-300, 0.0]),
        (10, [-1.0, 0.0]),
        (11, [1.0, 0.0, 0.0]),
        (7, [1.0, 0.0]),
        (7, [0.0, 1.0]),
        (None, [0.0, 2.0]),
        (None, [0.7, 0.7]),
        (-5, [2.0, 0.0]),
        (12, [5.0]),
        (13, [6.0]),
    ]
    assert judged(frame(rows, "vec_id long, embedding array<double>")) == linked(rows)


def test_no_vectors_and_other_columns(frame):
    empty = frame([], "vec_id long, embedding array<double>")
    assert judged(empty) == [] and judged(frame([(1, None)], "vec_id long, embedding array<double>")) == [(1, 0, 1, True)]
    schema = "node int, embedding array<float>, digest string, id int, unit int, vec_id long, copies int, n_links int"
    rows = [(1, [1.0, 2.0], "x", 5, 6, 3, 2, 9), (1, [1.0, 2.0], "x", 5, 6, 4, 2, 9)]
    assert judged(frame(rows, schema)) == [(3, 1, 3, True), (4, 1, 3, False)]


def test_balls_hold_linked_vectors_only():
    rule = vector_copies.CollisionRule()
    assert math.cos(2 * (rule.angle / 2 - vector_copies._MARGIN)) >= rule.cosine


def test_calibration_grows_with_the_rows():
    sample = directions(np.random.default_rng(4), 1024, 32)
    rule = vector_copies.CollisionRule()
    plans = [vector_copies.calibrate(sample, n, rule) for n in (1_000, 100_000, 10_000_000)]
    assert [p.signs for p in plans] == sorted({p.signs for p in plans}) and all(p.least >= vector_copies.LEAST_COUNT for p in plans)
    assert vector_copies.calibrate(np.ones((1, 1)), 1, rule).lists >= 1


# Merkle manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and the siblings to the left and right of each leaf, level by level."""
    paths, nodes = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        upper = []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            upper.append((sha(*(d for d, _ in run)), [i for _, b in run for i in b]))
        nodes = upper
    return nodes[0][0], paths


def manifest(rows, damage=lambda row: row):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(*row), leaf(*damage(row)), row[0]))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources]) if sources else (None, [])
    found = []
    for s, top in zip(sources, tops):
        subroot, paths = trees[s]
        for (_, _, own, changed, key), path in zip(sorted(groups[s], key=lambda r: r[:4]), paths):
            for left, right in path + top:
                changed = sha(left, changed, right)
            found.append((key, own, subroot, root, sha(*(a + b for a, b in path + top)), changed))
    return sorted(found, key=repr)


def built(df):
    bare = F.translate("text", "\n", "")
    changed = merkle_manifest.leaf_digest([bare if c == "text" else F.col(c) for c in FIELDS])
    found = merkle_manifest.merkle_manifest(df, FIELDS, carry={"changed": changed})
    folded = merkle_manifest.folded(F.col("path"), F.col("changed"))
    columns = ["id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof(F.col("path")), 256), folded]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def without_breaks(row):
    return (*row[:4], None if row[4] is None else row[4].replace("\n", ""))


ROWS = {
    "none": [],
    "one": [(1, "a", "en", 3, "x\n")],
    "four": [(i, "a", "en", 3, "x\ny") for i in range(4)],
    "more than a slot array": [(7 * i, "a" if i % 4 else "b", "en", i, f"t\n{i}") for i in range(2200)],
    "scattered and repeated": [
        (None, None, None, None, None),
        (None, "a", "x", 1, "q"),
        (None, "a", "x", 1, "q"),
        (5, "a", None, 2, ""),
        (5, "a", None, 2, ""),
        (5, "a", None, 3, "\n"),
        (5, "a", None, 3, None),
        (-7, "a", "x", 1, "z\n"),
        (2**63 - 1, "a", "x", 1, "z\n"),
        (-(2**63), "a", "x", 1, "z\n"),
        (1 << 40, "é", "x", 1, "z 🙂\n"),
        (1 << 20, "", "x", 1, "z\n"),
        (1 << 20, "=", "x", 1, "long " * 100_000),
    ]
    + [(9, "a", "e", 1, "same")] * 1500
    + [(i, f"s{i % 40}", "e", 1, "k\n") for i in range(100)],
}


@pytest.mark.parametrize("name", ROWS)
def test_manifest(frame, name):
    assert built(frame(ROWS[name], DOCUMENTS)) == manifest(ROWS[name], without_breaks)


def test_manifest_reads_its_columns_only(frame):
    rows = [(i, f"s{i % 2}", "en", i, "t") for i in range(9)]
    schema = DOCUMENTS + ", tree string, slot long, leaf string, word long, path string, n int, digest string"
    wide = frame([(*r, "x", 1, "x", 1, "x", 1, "x") for r in rows], schema)
    assert built(wide) == manifest(rows, without_breaks)


def test_untampered_leaves_lead_to_the_root(frame):
    found = merkle_manifest.merkle_manifest(frame(ROWS["four"], DOCUMENTS), FIELDS)
    folded = merkle_manifest.folded(F.col("path"), F.col("leaf"))
    assert [r[0] for r in found.select(folded == F.col("root")).collect()] == [True] * 4


# periodic runs


def all_runs(words_, least=6, exponent=4):
    """Every period tried on its own; a stretch found with a shorter one counts once."""
    n, found = len(words_), {}
    for period in range(1, n // exponent + 1):
        at = 0
        while at + period < n:
            begin = at
            while at + period < n and words_[at] == words_[at + period]:
                at += 1
            length = at + period - begin
            if at > begin and length >= max(least, exponent * period):
                found.setdefault((begin, length), period)
            at += at == begin
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words_, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words_) if i not in gone)


def test_runs_of_random_words():
    draw = random.Random(5)
    seen = 0
    for _ in range(4000):
        n = draw.randint(0, draw.choice([12, 60, 250]))
        letters = [draw.randrange(draw.choice([1, 2, 2, 3, 20])) for _ in range(n)]
        for _ in range(draw.randint(0, 4) if n > 3 else 0):
            start, period = draw.randrange(n), draw.randint(1, max(1, n // 4))
            for i in range(start + period, min(n, start + draw.randint(1, 8) * period)):
                letters[i] = letters[i - period]
        text = [str(x).encode() for x in letters]
        catchers, cut = periodic_runs.SquareCatchers(), draw.randint(0, n)
        catchers.append(text[:cut])
        assert catchers.runs() == all_runs(letters[:cut])
        catchers.append(text[cut:])
        assert catchers.runs() == all_runs(letters)
        assert periodic_runs.collapse(text, catchers.runs()).decode() == collapsed([w.decode() for w in text], catchers.runs())
        seen += len(catchers.runs())
    assert seen > 1000


def test_work_stays_bounded_on_words_that_repeat(frame):
    texts = ["x " * 300_000, ("a " * 5000 + "b ") * 60, " ".join("ab"[bin(i).count("1") % 2] for i in range(200_000))]
    rows = periodic_runs.find_runs(frame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["start"], r["length"], r["period"]) for r in rows[0].runs] == [(0, 300_000, 1)] and rows[0].collapsed == "x"
    assert len(rows[1].runs) == 61 and (0, 300_060, 5001) in {tuple(r) for r in rows[1].runs}
    assert rows[2].runs == [] and rows[2].n_words == 200_000


def test_edges_of_texts(frame):
    rows = [
        (1, None, "n"),
        (2, "", "n"),
        (3, " \t\r\n\x0b\f ", "n"),
        (4, "a a a a a", "n"),
        (5, "a a\ta\na  a\x0ba\fa", "n"),
        (6, "a a a a a a a a a a a a", "n"),
        (7, "é b é b é b é b é", "n"),
        (7, "é b é b é b é b é", "n"),
        (None, "A a A a A a A a", "n"),
    ]
    found = periodic_runs.find_runs(frame(rows, "doc_id long, text string, runs string"))
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in found.collect():
        words_ = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        runs = all_runs(words_)
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words_) and r.collapsed == collapsed(words_, runs)
    assert periodic_runs.find_runs(frame([], "doc_id long, text string")).count() == 0
    assert periodic_runs.find_runs(frame([(1,)], "doc_id long")).first().collapsed == ""
    with pytest.raises(ValueError):
        periodic_runs.find_runs(frame(rows, "doc_id long, text string, runs string"), exponent=3)


def planted(key, text):
    words_ = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words_), zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return words_
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words_[i] if i < a else words_[a + (i - a) % p] for i in range(n)]


def test_planted_runs(frame):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 90)))) for i in range(200)] + [(None, "a b"), (0, None)]
    got = with_planted_runs(frame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, (r.text or "").split()) for r in got) == sorted((k or -1, planted(k, t)) for k, t in rows)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no given tables")
def test_registered_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in registered.queries()["op13_dyadic_square_catching"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for key, text in docs:
        words_ = planted(key, text)
        if len(words_) > 3000:
            continue
        runs = all_runs(words_)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        milli = best[1] and 1000 * best[1] // best[2]
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert got[key] == (key, len(runs), *best, milli, sha(lines), sha(collapsed(words_, runs)))
