"""Operators on single rows: chat, HTML, WARC, packing, BPE, token files, toxicity."""

import hashlib
import itertools
import os
import random
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracequill.llm import bpe, chat, idfile, packing, queries, toxicity, warc, words, wrappers

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "  two  words ", "é à naïve «x», it's", "<|endoftext|> and <|STARTOFTEXT|>", "x" * 5000, "word " * 20000, "́   mixed\x1c\x85", "Å 中文 😀 123 don't", "tab\tnew\n\nline  "]


def documents(spark, texts=ODD, extra=True):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, c int")
    return df if extra else df.select("doc_id", "text")


TOKENIZERS = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def whole(path, t):
    return np.array(TOKENIZERS[path].encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def random_texts(n, seed):
    r = random.Random(seed)
    letters = [chr(c) for c in range(32, 0x2000)] + list(" \n\t'abcAB19<|") * 400
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def by_words(coder, texts):
    """Each text's ids as bytes, without the end id."""
    ids, begin = coder.encode(pa.array(texts, pa.string()), 7)
    assert len(begin) == len(texts) + 1 and (ids[begin[1:] - 1] == 7).all()
    return [ids[i : j - 1].tobytes() for i, j in zip(begin.tolist(), begin[1:].tolist(), strict=False)]


@pytest.mark.parametrize(("coder", "path", "encode"), [(words.WordCoder, WORD, by_words), (bpe.PairIndexBPE, BYTE, bpe.PairIndexBPE.encode_batch)])
def test_coders_equal_the_library(coder, path, encode):
    texts = [t or "" for t in ODD] + random_texts(1500, 3)
    small = coder(path, keep=300)
    for _ in range(2):
        got = [x for i in range(0, len(texts), 50) for x in encode(small, texts[i : i + 50])]
    assert [i for i, t in enumerate(texts) if got[i] != whole(path, t)] == []


def test_words_of_slices_and_nulls():
    coder = words.WordCoder(WORD)
    texts = pa.array([None, "a b", "", "  x <|endoftext|> y ", None, "c"], pa.string())
    for part in (texts, texts.slice(1, 4), texts.slice(5), texts.slice(0, 0)):
        assert by_words(coder, part) == [whole(WORD, t or "") for t in part.to_pylist()]


def test_bpe_round_trip(spark):
    tok = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(spark), BYTE).collect()}
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(documents(spark), BYTE).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        ids = np.frombuffer(got[i]["ids"], "<u4").tolist()
        assert bytes(got[i]["ids"]) == whole(BYTE, t) and got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(got[i]["ids"]).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(documents(spark).limit(0), BYTE).count() == 0


def check_packing(rows, want, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in ps) == want[d] and all(p["doc_tokens"] == len(want[d]) // 4 for p in ps)
        assert [p["start"] for p in ps] == [sum(q["length"] for q in ps[:i]) for i in range(len(ps))]
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [sum(q["length"] for q in ps[:i]) for i in range(len(ps))]
        total = sum(p["length"] for p in ps)
        assert total <= window and (total == window or total & total - 1 == 0)


@pytest.mark.parametrize("pool", [3, 4096])
def test_packing(spark, pool):
    texts = ODD + ["some words here " * k for k in range(60)]
    want = {i: whole(WORD, t) + np.array([2], "<u4").tobytes() for i, t in enumerate(texts)}
    check_packing(packing.pack(documents(spark, texts), WORD, window=256, pool=pool).collect(), want, 256)
    assert packing.pack(documents(spark).limit(0), WORD).count() == 0


def test_windows_come_from_the_program():
    """Most windows have no cut, whatever the lengths; a window is cut only where no multiset fills it, and then by its slack."""
    r = random.Random(8)
    for lengths in ([r.randint(1, 255) for _ in range(3000)], [100] * 500, [200, 200, 200, 57]):
        pool = packing.Pool(256)
        for i, n in enumerate(lengths):
            pool.add((i, 0, n, np.full(n, i, "<u4")))
        exact = list(pool.exact())
        assert all(sum(len(p[3]) for p in w) == 256 for w in exact)
        left = sum(s * len(x) for s, x in pool.held.items())
        rest = list(pool.rest())
        sizes = [sum(len(p[3]) for p in w) for w in rest]
        assert sizes == [256] * (left // 256) + [1 << b for b in range(8, -1, -1) if left % 256 >> b & 1] and not pool.held and pool.n == 0
        pieces = sorted((p[0], p[1], len(p[3])) for w in exact + rest for p in w)
        for i, n in enumerate(lengths):
            own = [p for p in pieces if p[0] == i]
            assert own[0][1] == 0 and sum(p[2] for p in own) == n and all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(own))
        cuts = len(pieces) - len(lengths)
        assert cuts <= len(rest) and (len(exact) > 0.8 * (len(exact) + len(rest)) or len(set(lengths)) < 3)


def test_subset_sums_against_brute_force():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(0, 6))}
        room = r.randint(0, 60)
        sums = {0}
        for s, c in counts.items():
            sums = {x + s * k for x in sums for k in range(c + 1)}
        best, used = packing.closest(counts, room)
        assert best == max(x for x in sums if x <= room) == sum(s * c for s, c in used.items())
        assert all(c <= counts[s] for s, c in used.items())


@pytest.mark.parametrize(("lanes", "steps", "vocab"), [(1, 1, 2), (3, 77, 300), (5, 400, 49408), (2, 300, 200_000)])
def test_range_coder_round_trip(lanes, steps, vocab):
    r = np.random.default_rng(lanes)
    ids = np.minimum(r.zipf(1.3, (lanes, steps)), vocab - 1)
    ids[:, steps // 2 :] = ids[:, : steps - steps // 2]
    coded = idfile.encode_blocks(ids, vocab)
    assert (idfile.decode_blocks(coded, steps, vocab) == ids).all()
    assert idfile.encode_blocks(ids[:1], vocab) == coded[:1]  # a block doesn't depend on its neighbours


def test_id_files(spark, tmp_path):
    texts = ODD + ["some words here " * k for k in range(40)]
    manifest = idfile.write_files(documents(spark, texts), WORD, folder=str(tmp_path))
    got = sorted(idfile.read_files(manifest).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = whole(WORD, t) + np.array([2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    path = next(p for p in sorted(tmp_path.iterdir()) if p.suffix == ".ids")
    raw = bytearray(path.read_bytes())
    raw[13] ^= 1  # the first word of the first block
    path.write_bytes(raw)
    with pytest.raises(Exception, match="damaged|differ|unpack|buffer"):
        idfile.read_files(manifest).collect()
    assert idfile.read_files(idfile.write_files(documents(spark).limit(0), WORD)).count() == 0


def test_repeated_ids_in_files(spark):
    df = documents(spark, ["b c", "a"]).withColumn("doc_id", F.lit(7).cast("long"))
    got = idfile.read_files(idfile.write_files(df.unionAll(df), WORD)).collect()
    assert len(got) == 4 and {r["doc_id"] for r in got} == {7}


def test_warc(spark):
    big, small = "<p>" + "x" * 2000, "<p>small"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, small), (4, "http://a/4\r\nX: y", small), (5, "u", None), (6, "u", ""), (9, "u", big), (9, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit("clash"))
    index = warc.write_bundles(df)
    got = warc.read_bundles(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(x[2] for x in rows if x[0] == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if r["page_id"] in (1, 2) else ("response", None))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html.encode()
    one = warc.read_record(index, 4).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == small.encode() and "\n" not in one[0]["url"]
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_seek_table(tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    with open(tmp_path / "x", "wb") as f:
        b = warc.Bundle(f)
        records = [bytes([i]) * 400_000 for i in range(10)]
        for i, r in enumerate(records):
            b.add(i, r)
        b.close()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
        table = warc.seek_table(f)
        assert len(table) > 2 and sum(t[2] for t in table) == 4_000_000
        for i, at, size, inner, n in b.index:
            f.seek(at)
            assert zstandard.ZstdDecompressor().decompress(f.read(size))[inner : inner + n] == records[i]


def test_chat(spark):
    t = chat.Template()
    turns = [(1, 0, "system", "be\\nice <|end|>"), (1, 1, "user", None), (1, 2, "assistant", "<|turn|>user<|says|>\\"), (2, 0, "assistant", "first"), (3, 0, None, "x"), (4, 5, "user", "b"), (4, 5, "user", "b"), (5, 0, "user", ""), (5, 1, "assistant", "l" * 9000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.formatted(df, t)
    got = {r["conv_id"]: r for r in out.select("*", chat.read_back(F.col("text"), t).alias("back"), chat.loss_text(F.col("segments"), t).alias("loss")).collect()}
    for c in {x[0] for x in turns}:
        own = [(x[2] or "", x[3] or "") for x in turns if x[0] == c]
        assert [tuple(x) for x in got[c]["back"]] == own
        assert got[c]["loss"] == "".join(s for r, s in own if r == "assistant")
        assert got[c]["text"] == "".join(s["text"] for s in got[c]["segments"])
    assert [got[c]["valid"] for c in (1, 2, 3, 4, 5)] == [True, False, False, False, True]
    assert got[4]["first_error"] == 1 and got[2]["first_error"] == 0
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_of_hostile_strings(spark):
    r = random.Random(2)
    parts = ["<|turn|>", "<|says|>", "<|end|>", "\\", "<", "|", "a", "\n", "$1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(150)]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = chat.formatted(df).select("conv_id", chat.read_back(F.col("text")).alias("b")).collect()
    assert {r["conv_id"]: r["b"][0]["text"] for r in got} == dict(enumerate(texts)) and all(len(r["b"]) == 1 for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>
<div class="ad">Buy</div><article><header>By me</header><h1>Title%d &amp; more</h1><p>One <b>bo</b>ld   text.<br>Two&nbsp;x<p>%s</p><aside>side</aside><div class="comments"><p>first!</p></div><form>f<input></form></article><footer>&copy; me</footer>"""


def test_wrappers(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE % (i, "long " * i)) for i in range(12)]
    rows += [(20, None, None), (21, "http://h0.example/z", ""), (22, "nonsense", "plain &lt;text&gt; only"), (23, "http://h0.example/cut", PAGE % (23, "x") + "<p"), (24, "http://h1.example/", "<article><p>a < b &amp"), (24, "http://h1.example/", "<article><p>a < b &amp")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("wrapper", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in wrappers.extract(df).collect()]
    assert len(got) == len(rows)
    text = dict(got)
    for i in range(12):
        assert text[i] == " ".join(f"Title{i} & more One bold text. Two x {'long ' * i}".split())
    assert (text[20], text[21], text[22], text[24]) == ("", "", "plain <text> only", "a < b &")
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrapper_without_article(spark):
    page = "<html><body><div>Site name</div><div><p>Story %d here</p></div><div>All rights</div></body></html>"
    df = spark.createDataFrame([(i, "http://w.example/", page % i) for i in range(6)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()} == {i: f"Story {i} here" for i in range(6)}
    # without the host's wrapper nothing tells the template from the story
    none = spark.createDataFrame([], "host string, wrapper string, pages long")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(df, none).collect()} == {i: f"Site name Story {i} here All rights" for i in range(6)}


def test_wrappers_of_generated_sites(spark):
    """Pages of a host without an article, against what is known of how they were made: template texts go, others stay."""
    r = random.Random(12)
    rows, want = [], {}
    for host in range(4):
        head, foot = [f"<div>head{host}{i}</div>" for i in range(r.randint(1, 3))], [f"<h3>foot{host}{i}</h3>" for i in range(r.randint(0, 2))]
        for page in range(5):
            key = host * 10 + page
            body = [f"<p>text{key} {i}</p>" for i in range(r.randint(1, 4))]
            rows.append((key, f"http://h{host}.example/{page}", "".join(["<html><body>", *head, *body, *foot, "</body></html>"])))
            want[key] = " ".join(f"text{key} {i}" for i in range(len(body)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()} == want


def test_alignment_covers_pages():
    a, _ = wrappers.expression("<ul><li>1</li><li>2</li></ul><p>x</p>")
    b, _ = wrappers.expression("<ul><li>1</li></ul><h2>new</h2><p>y</p>")
    w = wrappers.align(a, b)
    flat = [(wrappers.key(x), o) for x, o in wrappers._flat(w)]
    assert ("+(<li>#o</li>)", False) in flat and ("<h2>", True) in flat and ("<p>", False) in flat
    assert [x[2] for x, _ in wrappers._flat(w) if x[0] == "t" and x[1] == "#o"][-1] is None


def test_toxicity_learns_and_stays_in_bounds(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    extra = documents(spark).select("doc_id", "text", F.lit("s").alias("score"), F.lit("p").alias("probability"))
    got = model.score(extra).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["probability"] == "p" for r in got)
    m = model.score(docs).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    hit = m.predicted == 1
    assert m.toxic[hit].mean() > 0.9 and hit[m.toxic == 1].mean() > 0.5
    assert model.score(extra.limit(0)).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).score(documents(spark)).select("score").distinct().collect()[0][0] == 0.0


def plain_features(text, learnt):
    """The features again, word by word."""
    text = text or ""
    low = "".join(" " if 32 < ord(c) < 127 and not c.isalnum() else c for c in text.lower()).split()
    hits = [i for i, w in enumerate(low) if w in toxicity.SEED.split()]
    second = [i for i, w in enumerate(low) if w in toxicity.SECOND.split()]
    n, size = max(1, len(low)), max(1, len(text.encode()))
    return {
        "lexicon_density": len(hits) / n, "lexicon_kinds": len({low[i] for i in hits}), "learnt_density": sum(w.encode() in learnt for w in low) / n, "learnt_most": max([learnt[w.encode()] for w in low if w.encode() in learnt], default=0.0),
        "near_second": sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits) / max(1, len(hits)), "second_density": len(second) / n, "capitals": sum("A" <= c <= "Z" for c in text) / size,
        "marks": sum(32 < ord(c) < 127 and not c.isalnum() for c in text) / size, "exclaims": text.count("!") / n, "log_words": np.log1p(len(low)),
    }


@pytest.mark.parametrize("text", ["", None, "You IDIOT!! go away", "a fool and his money far far far far far away from you", "Tu es idiote, crétin", "fine words only", "id1ot you m0r0n $tupid", "STOP shouting, you trash!", "émeu ÉTÉ"])
def test_toxicity_features(text):
    learnt = {b"away": 1.5, b"words": 2.0}
    got = dict(zip(toxicity.NAMES, toxicity.features(text, learnt), strict=True))
    for name, value in plain_features(text, learnt).items():
        assert got[name] == pytest.approx(value), name
    assert got["learnt_weight"] >= got["learnt_most"]


def test_obfuscation_is_seen_through():
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    assert toxicity.features("you id1ot", {})[at["mixed_hits"]] == 0.5 and toxicity.features("you idiot", {})[at["mixed_hits"]] == 0 and toxicity.features("m0r0n x", {})[at["mixed"]] == 0.5


def test_registered_queries_have_the_contract_columns(spark, sf):
    want = {"op1": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op2": ["page_id", "url", "text", "n_chars"], "op3": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op4": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op5": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op6": ["doc_id", "held_out", "score", "predicted"], "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op8": ["doc_id", "start", "n_tokens", "ids_crc32"], "op9": ["query_id", "rank", "vec_id", "score"], "op10": ["doc_id", "n_shingles", "component_id"]}
    assert {k.split("_")[0] for k in queries.QUERIES} == set(want)
    for name, f in queries.QUERIES.items():
        if (k := name.split("_")[0]) in want:
            assert f(spark, sf).columns[: len(want[k])] == want[k]


def test_scripts_hold_no_markup():
    for script in ("for(i=0;i<n;i++){a[i]=1;}", "if(a<b){/* <!-- */}", "x='<!--'", "s=\"<p title='\""):
        page = f"<script>{script}</script><article><p>whole text</p></article><SCRIPT>a<b</SCRIPT ><style>a<b</style>"
        assert [t for name, _, t in wrappers.tokens(page) if not name] == ["whole text"]
    assert [t for name, _, t in wrappers.tokens("a<script>never ends <p>b") if not name] == ["a"]


def test_two_templates_on_a_host(spark):
    """Pages without an article keep their text whatever the others of the host have; only what two pages share is template."""
    plain = "<html><body><div>Site name</div><ul><li>one</li><li>two</li></ul><div><p>Story %d here</p></div>%s<div>All rights</div></body></html>"
    rows = [(i, "http://w.example/", PAGE % (i, "x")) for i in range(4)] + [(i, "http://w.example/", plain % (i, "<blockquote>only here</blockquote>" if i == 6 else "")) for i in range(4, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert text == {i: f"Title{i} & more One bold text. Two x x" for i in range(4)} | {i: f"Story {i} here" + " only here" * (i == 6) for i in range(4, 9)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://w.example/", "<div><p>the same page</p></div>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert [r["text"] for r in wrappers.extract(df).collect()] == ["the same page"] * 3


def test_ids_in_an_article_are_no_menus():
    page = '<article><h2 id="search" class="header">Search</h2><section id="comments"><p>on trees</p></section><section class="comments">first!</section><div id="share">me</div></article><h2 class="banner">B</h2>'
    assert [t for name, region, t in wrappers.tokens(page) if not name and region == "c"] == ["Search", "on trees"]


def test_long_lists_are_matched_like_short_ones():
    def plain(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        pairs, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return pairs

    r = random.Random(5)
    for _ in range(300):
        kinds = r.choice([1, 2, 4, 20])
        x, y = ([str(r.randrange(kinds)) for _ in range(r.randrange(40))] for _ in range(2))
        assert wrappers._longest(x, y) == plain(x, y)
        assert len(wrappers._matching(x, y)) == len(plain(x, y))
    many = [f"k{i}" for i in range(1100)]
    for n in (900, 1100):  # on both sides of a million pairs
        assert wrappers._matching(["last", *many[:n]], [*many[:n], "last"]) == [(i + 1, i) for i in range(n)]


def test_words_are_given_in_parts_and_forgotten(monkeypatch):
    monkeypatch.setattr(words, "GIVEN", 7)
    coder = words.WordCoder(WORD, keep=50)
    texts = [t or "" for t in ODD] + random_texts(60, 9)
    for i in range(0, len(texts), 9):
        part = texts[i : i + 9]
        assert by_words(coder, part) == [whole(WORD, t) for t in part]
        assert len(coder.known[0]) <= max(50, len({w for t in part for w in t.split()}) * 2 + 1)


GROWTH = """
import random, resource
import public_tokenizers, pyarrow as pa
from tracequill.llm import words
coder, r = words.WordCoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
coder.encode(pa.array(["a b"]), 2)
batches = [pa.array([" ".join("".join(r.choices("etaoinshrdlu", k=8)) for _ in range(100)) for _ in range(1600)]) for _ in range(2)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for b in batches:
    coder.encode(b, 2)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_worker_of_many_rare_words_stays_small():
    done = subprocess.run([sys.executable, "-c", GROWTH], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    print(done.stdout)
    assert int(done.stdout) < 150


def test_writers_wait_for_full_steps(tmp_path):
    """A step over few lanes costs as much as one over many, so all but the last steps have all lanes."""
    sizes = []
    with pa.OSFile(str(tmp_path / "a.ids"), "wb") as sink:
        w = idfile.Writer(sink, 100, block=8, lanes=4)
        write = w._write
        w._write = lambda ids: (sizes.append(ids.shape), write(ids))
        for i in range(3):
            w.add([i], np.arange(44, dtype="<u4"), np.array([0, 44]))
        assert w.close() == 132
    assert sizes == [(4, 8), (4, 8), (4, 8), (4, 8), (1, 4)]
    with pa.OSFile(str(tmp_path / "a.ids"), "rb") as f:
        assert [(d, ids.tolist()) for d, ids in idfile.read_file(f)] == [(i, list(range(44))) for i in range(3)]


def test_neighbouring_lanes_share_lines_of_the_cache():
    """A fresh step's counters lie side by side, not each lane's in a line of its own."""
    m = idfile.Model(64, 49408)
    m.guess(m.base)
    assert len(np.unique(m.cell // 16)) == 2 * 64 // 16


def test_few_words_cost_little_however_many_are_remembered():
    """The table that words are looked up in is made of a slice's words, not of all that a worker remembers."""
    coder = words.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    many = pa.array([f"word{i:x}" for i in range(300_000)])
    ones = np.ones(len(many), np.int32)
    coder.known = many, np.arange(len(many), dtype="<u4"), np.arange(len(many), dtype=np.int32), ones
    few = many.slice(1000, 3)

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    ids, start, length = coder._ids_of(few)
    assert [ids[a : a + n].tolist() for a, n in zip(start, length, strict=True)] == [[1000], [1001], [1002]]
    assert least(lambda: coder._ids_of(few)) < 0.3 * least(lambda: pc.index_in(few, many))
