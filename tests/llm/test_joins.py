"""Near copies, benchmark passages, vectors, components and the pipeline against brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from fixtures import documents, empty, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from mapweave.llm import decontamination, ngram_join, vector_dedup
from mapweave.llm.components import components


def classes(items, linked):
    """Smallest item reachable, for each item."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(9, 9)]
    want = classes({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def chains():
    """Texts that are linked only through others, and a passage that many share."""
    rng = random.Random(3)
    rows = list(texts())
    w = words(rng, "fr", 120).split()
    for k in range(8):
        rows.append((500 + k, " ".join(w), "fr"))
        for _ in range(2):
            w[rng.randrange(120)] = f"x{k}"
    shared = words(rng, "en", 70)
    rows += [(600 + k, shared + " " + words(rng, "en", 40 + k), "en") for k in range(30)]
    return rows


def test_near_copies_equal_brute_force(spark):
    rows, percent = chains(), 80
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in ngram_join.join(documents(spark, rows), percent=percent).collect())
    sets = [shingles(t) for _, t, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = classes(range(len(rows)), pairs)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[of[k]] = min(least.get(of[k], i), i)
    want = sorted((-1 if i is None else i, len(sets[k]), least.get(of[k], -1)) for k, (i, _, _) in enumerate(rows))
    assert got == want


@pytest.mark.parametrize("shared", [150, 700])
def test_long_texts_with_one_passage_in_common_make_few_pairs(spark, monkeypatch, shared):
    """No two are alike; the last join must not make their square."""
    rng = random.Random(5)
    passage, n = words(rng, "en", shared), 300
    own = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(rng.randrange(1200, 1500))) for _ in range(n)]
    rows = [(k, f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}", "en") for k, t in enumerate(own)]
    kept = {}
    real = ngram_join.written

    def keep(df, name, *by):
        out = real(df, name, *by)
        if name == "rest":
            kept["made"] = ngram_join._apart(out, 80).count()
        return out

    monkeypatch.setattr(ngram_join, "written", keep)
    got = ngram_join.join(documents(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == n
    assert kept["made"] <= n


def test_frequency_levels_put_shared_passages_last(spark):
    rows = [(k, f"only in text {k} one two three " + "a passage that all the texts hold " * 2, "en") for k in range(64)]
    levels = ngram_join.frequency_levels(documents(spark, rows).select("text"))
    grams = {g for _, t, _ in rows for g in ngram_join.shingles(pa.array([t]))[0].tolist()}
    of = {g: int(levels[ngram_join._slot(np.array([g], np.uint64))][0]) for g in grams}
    assert sorted(set(of.values())) == [0, 12] and sum(v == 12 for v in of.values()) >= 7


def test_repeated_rows_leave_one(spark):
    rows = [(1, "the same row with enough words in it", "en")] * 7 + [(2, "the same row with enough words in it", "en"), (3, None, "en"), (3, None, "en")]
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(documents(spark, rows)).select("doc_id", "text").collect() if r["text"])
    assert kept == [(1, "the same row with enough words in it")]
    assert ngram_join.keep_one(empty(spark)).collect() == []


def test_one_of_each_class_stays(spark):
    rows = chains()
    kept = ngram_join.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    found = ngram_join.join(documents(spark, rows)).collect()
    assert sum(bool((r["text"] or "").split()) for r in kept.collect()) == len({r["class_id"] for r in found if r["class_id"] is not None})
    assert sorted(r["doc_id"] for r in kept.where("doc_id between 100 and 119").collect()) == [100]
    assert {130, 131, 132} <= {r["doc_id"] for r in kept.collect()}


def test_near_copies_of_nothing(spark):
    assert ngram_join.join(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=30))
def test_longest_stretch(same):
    a, b = decontamination.longest_stretch(np.array(same))
    best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 100 * sum(same[i:j]) >= 80 * (j - i)), default=0)
    assert b - a == best and (best == 0 or 100 * sum(same[a:b]) >= 80 * best)


def test_benchmark_passages_are_found(spark):
    rng = random.Random(9)
    items = [(k, words(rng, "en", 30)) for k in range(5)] + [(5, "only four small words"), (6, None), (7, ""), (8, words(rng, "de", 400))]
    def hidden(text, change=0):
        w = text.split()
        for k in range(change):
            w[3 + 9 * k] = "changed"
        return f"{words(rng, 'fr', 20)}\n{' '.join(w)} {words(rng, 'fr', 20)}"
    rows = list(texts()) + [(1000 + k, hidden(t), "en") for k, t in items if t] + [(1100 + k, hidden(items[k][1], 3), "en") for k in range(5)]
    rows += [(1200, hidden(items[0][1]).upper(), "en"), (1201, hidden(" ".join(items[1][1].split()[5:25])), "en"), (1202, hidden(" ".join(items[1][1].split()[5:13])), "en"), (None, hidden(items[2][1]), "en"), (1203, rows[-1][1], "en"), (1203, rows[-1][1], "en")]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, row int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in decontamination.leaks(documents(spark, rows), benchmark).collect())
    want = [(1000 + k, k) for k, t in items if t] + [(1100 + k, k) for k in range(5)] + [(1200, 0), (1201, 1), (-1, 2), (1203, 4), (1203, 4)]
    assert got == sorted(want)
    left = decontamination.clean(documents(spark, rows), benchmark)
    assert left.count() == len(rows) - len(want) and left.columns == documents(spark, rows).columns
    assert decontamination.leaks(documents(spark, rows), benchmark.limit(0)).count() == 0
    assert decontamination.leaks(empty(spark), benchmark).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(4, 24))
    for i in range(400):
        rows.append((i, rng.normal(size=24).tolist(), i % 3))
    for i in range(260):  # one large group of near copies, and chains
        rows.append((1000 + i, (centre[0] + rng.normal(size=24) * 0.12).tolist(), 1))
    for i in range(40):
        rows.append((2000 + i, (centre[1] + rng.normal(size=24) * 0.3).tolist(), 2))
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [float("nan")] + [1.0] * 23, 1), (3004, [None] + [1.0] * 23, 1), (3005, centre[0].tolist(), None), (3006, centre[2].tolist(), 0), (3007, (5 * centre[2]).tolist(), 0), (3008, centre[2].tolist()[:12], 0), (3006, centre[2].tolist(), 0), (None, centre[3].tolist(), 0), (3009, [float("inf")] * 24, 0)]
    return rows


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TARGET", 60)
    monkeypatch.setattr(vector_dedup, "BLOCK", 100)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, k, 1) for i, v, k in rows], "vec_id long, embedding array<double>, label int, key int")
    got = {}
    for r in vector_dedup.dedup(frame).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert sum(map(len, got.values())) == len(rows)
    nodes = {}
    for i, v, k in rows:
        if v and k is not None and None not in v and np.isfinite(v).all() and any(v):
            nodes[i] = (np.array(v) / np.linalg.norm(v), k)
    pairs = [(a, b) for a in nodes for b in nodes if a is not None and b is not None and a < b and nodes[a][1] == nodes[b][1] and len(nodes[a][0]) == len(nodes[b][0]) and nodes[a][0] @ nodes[b][0] >= 0.93]
    of = classes([i for i in nodes if i is not None], pairs)
    links = {i: sum(i in p for p in pairs) for i in of}
    assert sum(g[0][0] for g in got.values()) >= 0.98 * sum(links.values())
    assert all(got[i][0][0] <= links[i] for i in of)
    assert np.mean([got[i][0][1] == of[i] for i in of]) >= 0.99
    assert all(got[i] == [(0, i, True)] for i in (3000, 3001, 3002, 3003, 3004, 3005, 3008, 3009))
    assert got[3006] == [(1, 3006, True)] * 2 and got[3007] == [(1, 3006, False)]
    assert vector_dedup.dedup(frame.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark):
    clashing = {c: F.lit(i) for i, c in enumerate(["score", "predicted", "lang_pred", "row", "class_id", "size", "node", "held_out"])}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(clashing)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "benchmark", "packing"]
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.select(*clashing).distinct().collect() == [tuple(range(len(clashing)))]
        assert after <= before and docs.count() == len(after)
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == packed.count()
    assert {r["doc_id"] for r in packed.collect()} == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_on_odd_rows_equals_brute_force(spark):
    """Nulls, repeated rows, copies and foreign columns through all stages, against plain rules where they are stated."""
    real = [(1000 + k, r["text"], "en") for k, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect())]
    rows = [*real, *texts()[60:70], (130, None, "en"), (131, "", "de"), (133, "12 34 !?", "en"), (None, texts()[3][1], "en"), *[real[4]] * 3]
    docs = documents(spark, rows)
    names = docs.columns

    def now(df):
        assert df.columns == names
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    left = now(clean)
    assert set(left) <= {(i, t) for i, t, _ in rows}
    spoken = stages["language"](spark, clean, SF)
    assert now(spoken) == [(i, t) for i, t in left if t and any(c.isalpha() for c in t)]

    kept = stages["near_copies"](spark, spoken, SF)
    before = now(spoken)
    sets = [shingles(t) for _, t in before]
    pairs = [(a, b) for a in range(len(before)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = {}
    for k, root in classes(range(len(before)), pairs).items():
        groups.setdefault(root, []).append(before[k])
    assert now(kept) == sorted((min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()), key=str)

    final = stages["benchmark"](spark, kept, SF)
    found = {r["doc_id"] for r in decontamination.leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert now(final) == [r for r in now(kept) if r[0] not in found]
    packed = stages["packing"](spark, final, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in now(final)} and all(r["length"] <= 2048 for r in packed)
    assert stages["packing"](spark, final.limit(0), SF).count() == 0
    for name in ("toxicity", "language", "near_copies", "benchmark"):
        assert stages[name](spark, docs.limit(0), SF).count() == 0
