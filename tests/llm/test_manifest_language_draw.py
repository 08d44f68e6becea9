"""Merkle manifest, language by cross-parsing, importance resampling: each against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracequill.llm import importance, languages, merkle, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """The top of a list of hashes, and the siblings of each at every level."""
    proofs, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(of):
            run = nodes[i // fanout * fanout : (i // fanout + 1) * fanout]
            proofs[leaf] += run[: i % fanout] + run[i % fanout + 1 :]
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        of = [i // fanout for i in of]
    return nodes[0], proofs


def plain_tree(rows, fanout):
    """By (id, source, leaf): subroot and siblings up to the root; and the root. rows: (id, source, text)."""
    leaf = {r: H(plain_field(r[0]), plain_field(r[1]), plain_field(r[2])) for r in rows}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf[r]))
        tops[g] = climb([leaf[r] for r in groups[g]], fanout)
    root, above = climb([tops[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above, strict=True):
        out += [(r[0], leaf[r], tops[g][0], "".join(p + up)) for r, p in zip(groups[g], tops[g][1], strict=True)]
    return root, sorted(out, key=repr)


@pytest.mark.parametrize(("sizes", "fanout"), [((1,), 16), ((1, 2, 16, 17, 40), 16), ((300, 1, 1, 5, 33), 4), ((3,) * 20, 2)])
def test_manifest(spark, sizes, fanout):
    r = random.Random(1)
    rows = [(i if r.random() > 0.05 else None, None if g == 1 else f"sé{g}", r.choice([None, "", "same", f"text {i}"])) for g, n in enumerate(sizes) for i in range(n)]
    rows += rows[:1] * 3  # repeated rows are leaves of their own
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"root": F.lit(1), "path": F.lit(2), "_pos": F.lit(3)}).repartition(5)
    m = merkle.build(df, [F.col("doc_id"), F.col("source"), F.col("text")], fanout=fanout)
    root, want = plain_tree(rows, fanout)
    got = merkle.proofs(m).collect()
    assert m.root() == root and all(x["verified"] and x["folded_root"] == root == x["root"] for x in got)
    assert sorted(((x["id"], x["leaf"], x["subroot"], x["proof"]) for x in got), key=repr) == want
    wrong = merkle.proofs(m, F.sha2(F.col("leaf").cast("binary"), 256)).agg(F.count("*"), F.count_if("verified")).first()
    assert tuple(wrong) == (len(rows), 0)


def test_manifest_of_nothing_and_of_one_hot_row(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    fields = lambda d: [d["doc_id"], d["source"], d["text"]]
    m = merkle.build(empty, fields(empty))
    assert m.root() is None and merkle.proofs(m).count() == 0
    same = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("x" * 1000).alias("text")).repartition(8)
    m = merkle.build(same, fields(same))
    assert merkle.proofs(m).where("verified").count() == 5000 and m.leaves.agg(F.countDistinct("_pos"), F.max("_pos")).first()[:] == (5000, 4999)


def test_tampering_shows(spark, sf):
    got = queries.op11_merkle_manifest(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    wrong = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.coalesce(F.regexp_like("text", F.lit("[A-Z]")), F.lit(False))
    assert got.join(docs, "doc_id").where(F.col("verified") == wrong).count() == 0


TEXTS = [None, "", "...", "a", "One two; ONE twoé 中文x9", "a b c d e f g h i j k l m n o p q r s t u", "x" * 9000, "hot " * 6000, "ÀBç d-e_f", "no end" * 300] + [" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(30)]


def plain_features(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize(("n", "size"), [(1, 50), (2, 64), (3, 64), (2, 1_000_000), (4, 7)])
def test_blocks_lose_no_feature(n, size):
    texts = pa.array(["lead", *TEXTS], pa.string()).slice(1)  # with an offset
    got = [[] for _ in TEXTS]
    for row, block in importance.blocks(texts, n, size):
        for text, tuples, number in block.features(n):
            assert len(set(tuples.to_pylist())) == len(tuples)
            for i, t in zip(text.tolist(), number.tolist(), strict=True):
                got[row + i].append(tuples[t].as_py().decode())
    assert [sorted(g) for g in got] == [sorted(plain_features(t, n)[1]) for t in TEXTS]


def plain_draw(docs, target, percent, least, count, seed):
    found = [plain_features(t, 2) for _, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % count
    s, t = np.zeros(count, int), np.zeros(count, int)
    for _, fs in found:
        for f in fs:
            s[bucket(f)] += 1
    for x in target:
        for f in plain_features(x, 2)[1]:
            t[bucket(f)] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + count) / ((s[b] + 1) * (T + count)))) for b in range(count)]
    rows = []
    for (i, _), (words, fs) in zip(docs, found, strict=True):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = percent * len(order) // 100
    return sorted(((*r[:4], order.index(r) + 1 if r in order[:n] else None) for r in rows), key=repr)


def test_draw(spark):
    docs = [(i if i != 20 else None, t) for i, t in enumerate(TEXTS)]
    target = ["a b c", None, "one two", "zzz"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "n_words": F.lit(1)}).repartition(4)
    td = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, td, percent=40, count=97).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_draw(docs, target, 40, 20, 97, 7)
    assert importance.resample(df.limit(0), td.limit(0)).count() == 0
    none = importance.resample(df, td.limit(0), count=97)
    assert none.count() == len(docs) and none.where("rank IS NOT NULL").count() == 33 * 25 // 100


def plain_phrases(text, sample, block):
    """Greedy longest matches, block by block."""
    total, parts = 0, sample.split(bytes([languages.APART]))
    for at in range(0, len(text), block):
        piece, i = text[at : at + block], 0
        while i < len(piece):
            j = i + 1
            while j <= len(piece) and any(piece[i:j] in p for p in parts):
                j += 1
            i = max(i + 1, j - 1)
            total += 1
    return total


def test_phrases_equal_greedy_matches():
    r = random.Random(3)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(1, 6)))
    samples = {}
    for name, letters in (("x", "abcd"), ("y", "cdefé"), ("z", "中文ab")):
        data = [" ".join(word(letters) for _ in range(40)) for _ in range(3)]
        samples[name] = bytes([languages.APART]).join(d.encode() for d in data)
    parsers = languages.Parsers(samples)
    texts = [" ".join(word("abcdefé中文qz") for _ in range(r.randint(0, 200))) for _ in range(40)] + ["", "q" * 700, "A-B ÉÉ  c"]
    arr = pa.array(["lead", *texts]).slice(1)
    data, begins = languages.prepared(arr)
    parts = [data[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
    assert parts[-1] == "a b éé c".encode()
    got = np.concatenate([p for _, _, _, p in parsers._parsed(arr)], axis=1)
    for k, name in enumerate(parsers.names):
        assert got[k].tolist() == [plain_phrases(p, samples[name], languages.BLOCK) for p in parts]


def test_languages_on_held_out_rows(spark, sf):
    got = queries.op12_cross_parsing_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    right = got.where("n >= 40").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.avg(F.when(F.col("held_out"), (F.col("lang_pred") == F.col("lang")).cast("int"))), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and right[1] > 0.97 and 0 <= right[2] and right[3] <= 1
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got.where("held_out").collect()} == {True}


def test_languages_of_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("12 ...", "fr"), ("the dog", None), ("le chien " * 30000, "fr")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "h": F.lit(1), "_said": F.lit("odd")})
    model = languages.fit(df, passages=4)
    out = model.predicted(df)
    assert [c for c in out.columns if c not in ("lang_pred", "score")] == ["doc_id", "text", "lang", "h", "_said"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["_said"]) for r in out.collect()}
    assert [got[i][0] for i in range(6)] == ["en", "fr", "und", "und", "en", "fr"] and got[2][1] == got[3][1] == 0 and all(0 <= s <= 1 and o == "odd" for _, s, o in got.values())
    assert {r["lang_pred"] for r in languages.fit(df.limit(0)).predicted(df).collect()} == {"und"}
    assert {r["score"] for r in languages.fit(df.where("lang = 'fr'")).predicted(df.where("doc_id = 0")).collect()} == {1.0}
    assert model.predicted(df.limit(0)).count() == 0
