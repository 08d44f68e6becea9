"""The registered queries of this subpackage, with the contract's digest columns, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.llm import bpe, chat, exact_dedup, idfile, importance, jaccard, languages, merkle, packing, topk, toxicity, warc, wrappers
from tracequill.llm.common import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Conversation -7: texts that look like control strings of common templates.
HOSTILE = "VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
#: A template whose control strings occur in those texts.
CHAT = chat.Template(opens="[TURN]", after_role="[/TURN]", closes="</s>")


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.formatted(turns.unionByName(spark.sql(f"SELECT * FROM {HOSTILE}")), CHAT)
    turns_back = chat.read_back(F.col("text"), CHAT)
    said = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.select("conv_id", turns_back.alias("turns"), chat.loss_text(F.col("segments"), CHAT).alias("loss"), F.length("text").cast("long").alias("formatted_chars"), "valid")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


SQL["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '[TURN]', '[\TURN]'), '[/TURN]', '[\/TURN]'), '</s>', '<\/s>') AS text_out,
    replace(replace(replace(replace(role, '\', '\\'), '[TURN]', '[\TURN]'), '[/TURN]', '[\/TURN]'), '</s>', '<\/s>') AS role_out,
    lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role_out) + length(text_out) + length('[TURN]') + length('[/TURN]') + length('</s>')) AS BIGINT) AS formatted_chars,
  bool_and((coalesce(before, 'start') || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'tool>assistant'))
    AND bool_or(from_end = 1 AND role IN ('assistant', 'user')) AS valid
FROM e GROUP BY conv_id
"""


@query
def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc_bundles"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), w AS (
  SELECT body, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY body
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN w.winner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.body = w.body
"""


@query
def op4_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_exact_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


SQL["op5_exact_content_sort"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id DESC NULLS LAST) = 1 AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


@query
def op6_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idfile.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return idfile.read_files(manifest, with_ids=False)


@query
def op9_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors["vec_id"] % 50 == 0, k=5)


SQL["op9_ball_tree_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


@query
def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), n=4, percent=85)


LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, merkle.leaf(fields(F.translate("text", *LETTERS))))
    out = merkle.proofs(merkle.build(docs, fields(F.col("text")), carry={"tampered": tampered}), F.coalesce("tampered", "leaf"))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, as SQL: bit by bit."""
    step = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))), {step}), CAST(4294967295 AS BIGINT))"


def _merkle_sql(levels: int = 7) -> str:
    """Levels of runs of 16 by windows, each node with its run's hashes before and after it; a group with one node left goes on as it is. Leaves, then subroots."""
    f = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"translate(text, '{LETTERS[0]}', '{LETTERS[1]}')"
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, source, {f('source')} AS g, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other FROM documents)",
        "n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, leaf AS h FROM d)",
        "l0 AS (SELECT r, g, doc_id, source, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, other AS f, '' AS proof FROM d)",
    ]

    def climb(n: str, at: str) -> None:
        """From n0 and l0 up to the level at which all groups have one node."""
        for k in range(levels):
            parts.append(f"{n}p{k} AS (SELECT g, i // 16 AS i, list(h ORDER BY i) AS hs, max(count(*)) OVER (PARTITION BY g) = 1 AND count(*) OVER (PARTITION BY g) = 1 AS one FROM {n}{k} GROUP BY g, i // 16)")
            parts.append(f"{n}{k + 1} AS (SELECT g, i, CASE WHEN one THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {n}p{k})")
            others = "array_to_string(list_concat(p.hs[:l.i % 16], p.hs[l.i % 16 + 2:]), '')"
            folded = "sha256(array_to_string(list_concat(p.hs[:l.i % 16], [l.f], p.hs[l.i % 16 + 2:]), ''))"
            parts.append(f"{at}{k + 1} AS (SELECT l.* EXCLUDE (i, f, proof), p.i, CASE WHEN p.one THEN l.f ELSE {folded} END AS f, l.proof || CASE WHEN p.one THEN '' ELSE {others} END AS proof FROM {at}{k} l JOIN {n}p{k} p ON p.g = l.g AND p.i = l.i // 16)")

    climb("n", "l")
    parts.append(f"s AS (SELECT n.g AS of, n.h, row_number() OVER (ORDER BY x.source NULLS FIRST) - 1 AS i FROM n{levels} n JOIN (SELECT DISTINCT g, source FROM d) x ON n.g = x.g)")
    parts.append("t0 AS (SELECT 0 AS g, i, h FROM s)")
    parts.append(f"u0 AS (SELECT l.doc_id, l.leaf, s.h AS subroot, 0 AS g, s.i, l.f, l.proof FROM l{levels} l JOIN s ON s.of = l.g)")
    climb("t", "u")
    return "WITH " + ", ".join(parts) + f" SELECT u.doc_id, u.leaf, u.subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.f AS folded_root, u.f = t.h AS verified FROM u{levels} u JOIN t{levels} t ON true"


SQL["op11_merkle_manifest"] = _merkle_sql()


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _importance_sql() -> str:
    """Features one by one; their crc32 byte by byte, from a table of 256 entries that SQL makes."""
    lower = f"translate(text, '{LETTERS[0]}', '{LETTERS[1]}')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = lambda t: f"SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {t}"
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents)",
        f"b AS (SELECT 0 AS r, coalesce({words}, []) AS w FROM benchmark)",
        f"df AS ({runs('d')})",
        f"bf AS ({runs('b')})",
        "known AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf))",
        "t AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS t FROM range(256) AS q(i))",
        "h AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS k FROM known, t)",
        "dk AS (SELECT k, count(*) AS s FROM df JOIN h USING (f) GROUP BY k)",
        "bk AS (SELECT k, count(*) AS t FROM bf JOIN h USING (f) GROUP BY k)",
        "g AS (SELECT i AS k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bf) + 10000)))) AS BIGINT) AS gain FROM range(10000) AS q(i) LEFT JOIN dk ON dk.k = q.i LEFT JOIN bk ON bk.k = q.i)",
        "p AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (k) GROUP BY r)",
        "s AS (SELECT doc_id, d.r, len(w) >= 20 AS enough, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN p ON p.r = d.r)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id, r) AS place FROM s)",
    ]
    return "WITH " + ", ".join(parts) + " SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 25 * (SELECT count(*) FROM s WHERE enough) // 100 THEN place END AS rank FROM o"


SQL["op13_importance_resampling"] = _importance_sql()


@query
def op12_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.fit(docs.where(~languages.held_out(F.col("doc_id"))))
    out = model.predicted(docs.select("doc_id", "text"))
    return out.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
