"""Operators that compare rows: exact dedup, Jaccard join, top-k, and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
from compare import connected, rows
from pyspark.sql import functions as F

import corpus_pipeline
from tracequill.llm import exact_dedup, jaccard, queries, topk


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), connected(sf).execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_exact_groups(spark):
    texts = ["a", None, "", "b", "a", "A", "b" * 300, "b" * 300, "b" * 299 + "c", "a"]
    data = [(i, t) for i, t in enumerate(texts)] + [(9, "a")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("run", F.lit(1)).repartition(3)
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.groups(df, keep=keep).collect()
        assert len(got) == len(data)
        for r in got:
            same = [i for i, t in data if (t or "") == (texts[r["doc_id"]] or "")]
            assert r["keep_id"] == best(same) and r["group_size"] == len(same)
        assert sum(r["kept"] for r in got) == len({t or "" for _, t in data})
    assert exact_dedup.groups(df.limit(0)).count() == 0
    left = exact_dedup.deduplicated(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 7, 8, 9]


def test_a_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(7)
    got = exact_dedup.groups(df).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.count_if("kept"), F.max("group_size")).first()
    assert tuple(got) == (1500, 2998, 2998, 1, 1500)


def near_copies(seed, groups=8, size=6, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(10, words))]
        for k in range(size):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            out.append(" ".join(x + (passage if k % 3 == 0 else [])))
    return out + [None, "", "  ", "One two", "one two", "one", "x " * 3000, " ".join(passage), " ".join(passage)]


def brute(texts, n, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("n", "percent", "classes", "frequent"), [(4, 85, 1000, 65536), (2, 70, 3, 65536), (3, 80, 2, 10)])
def test_jaccard_groups(spark, monkeypatch, n, percent, classes, frequent):
    monkeypatch.setattr(jaccard, "AREA_CLASSES", classes)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    texts = near_copies(n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"c": F.lit(1), "area": F.lit("clash")}).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(df, n, percent).collect()}
    want = brute(texts, n, percent)
    assert got == want and len({c for _, c in want.values()}) < len(texts)
    kept = jaccard.one_of_each(df, n, percent)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.groups(df).count() == 0
    two = spark.createDataFrame([(1, None), (1, None), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.groups(two).collect())) == [(1, 0, 1), (1, 0, 1), (2, 2, 2), (2, 2, 2)]


def test_a_large_group_is_compared_in_one_region(spark, monkeypatch):
    """A group larger than an area has many pivots; the classes that can't be linked to it are compared with its classes once, not once for each pivot."""
    monkeypatch.setattr(jaccard, "AREA_CLASSES", 8)
    blocks, inner, calls = jaccard._blocks, [], []

    def watched(core, outer, percent, is_core=True):
        calls.append(is_core)
        inner.extend(r["c"] for r in core.select("c").collect() if is_core)
        return blocks(core, outer, percent, is_core)

    monkeypatch.setattr(jaccard, "_blocks", watched)
    r = random.Random(3)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts = []
    for k in range(60):
        x = list(base)
        for at in r.sample(range(200), k % 10):
            x[at] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.groups(df, 3, 80).collect()}
    assert got == brute(texts, 3, 80)
    assert inner and len(inner) == len(set(inner)) and calls == [True, False]


def test_triangle_windows_alone():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 30))) for _ in range(60)]
    area = jaccard._Area(sets, 60)
    area.solve(list(range(60)))
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert [area.find(i) for i in range(60)] == [find(i) for i in range(60)]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 4)
    r = random.Random(1)
    vectors = [[r.uniform(-2, 2) for _ in range(6)] for _ in range(300)] + [[1.0] * 6] * 150 + [None, [1.0, None], [float("nan")], [float("inf")], [], [0.5]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for q, rank, v, s in topk.top_k(df, F.col("vec_id") % 50 == 0, k=7, shard=40 * 6).collect():
        got.setdefault(q, []).append((rank, v, s))
    for q in [i for i in fine if i % 50 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q))[:7]  # zip ends with the shorter one, as zeros would
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert len(got) == len([i for i in fine if i % 50 == 0])
    for first in (1, 1000):  # shards asked first matter to speed alone
        again = topk.top_k(df, F.col("vec_id") % 50 == 0, k=7, shard=40 * 6, first=first).collect()
        assert sorted((q, rank, v, s) for q, rank, v, s in again) == sorted((q, *x) for q, xs in got.items() for x in xs)
    twice = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [3.0]), (2, [3.0]), (0, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice, F.col("vec_id") == 1, k=5).orderBy("rank").collect()] == [(1, 1, 2, 256 * 768), (1, 2, 2, 256 * 768), (1, 3, 0, 65536)]
    few = topk.top_k(df.limit(3), F.col("vec_id") == 0, k=5).collect()
    assert len(few) == 2
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_big_integers_stay_exact():
    a = np.array([[2**40, 3], [5, -(2**35)]])
    assert topk.scores(a[:1] // 2**20, a // 2**20).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(a[0] // 2**20, b // 2**20))) for b in a]]


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, folder, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() > 0.7 * docs.count()
    alone = corpus_pipeline.drop_copies(spark, kept, folder).toPandas()
    p = kept.toPandas()
    assert sorted(alone.doc_id) == sorted(p.groupby(p.text.fillna("")).doc_id.max())
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(alone), folder).toPandas()
    texts = alone.sort_values("doc_id").reset_index(drop=True)
    want = brute(texts.text.tolist(), 5, 80)
    assert sorted(near.doc_id) == sorted(texts.doc_id[c] for c in {c for _, c in want.values()})
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(near), folder).toPandas()
    assert set(packed.doc_id) == set(near.doc_id) and packed.groupby("doc_id").length.sum().eq(packed.groupby("doc_id").doc_tokens.first()).all()
    assert set(corpus_pipeline.run(spark, folder).toPandas().doc_id) == set(near.doc_id)


def test_kept_rows_where_ids_are_repeated(spark):
    """Rows are chosen, not ids: a repeated row stays once, and a dropped text doesn't return by an id that another text has."""
    data = [(5, "p"), (7, "p"), (7, "p"), (5, "q"), (None, "q"), (None, "r"), (None, "r")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    left = [(r["doc_id"], r["text"]) for r in exact_dedup.deduplicated(df).collect()]
    assert sorted(left, key=str) == sorted([(7, "p"), (5, "q"), (None, "r")], key=str)
    words = {"p": "a b c d e f", "near": "a b c d e f g", "q": "one two three four five six", "r": "x y z x y z"}
    data = [(1, "p"), (5, "p"), (5, "near"), (5, "q"), (5, "q"), (1, "r"), (None, "r"), (8, None), (8, None), (9, "")]
    df = spark.createDataFrame([(i, words.get(t, t)) for i, t in data], "doc_id long, text string").repartition(3)
    left = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(df, 3, 80).collect()]
    assert sorted(left, key=str) == sorted([(1, words["p"]), (5, words["q"]), (1, words["r"]), (8, None), (8, None), (9, "")], key=str)
