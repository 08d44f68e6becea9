"""Scans of whole requests: the segments of their messages, the worst of them, and the fused score."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import deep_scans, text_scans

#: From which score of a classifier on phrases bear it out, and the share of its threshold that is suspicious.
CORROBORATED, SUSPICIOUS = 0.40, 0.6
#: Characters that a classifier sees of the start and of the end of a request.
WINDOW = 2048


def segments(messages: Column) -> Column:
    """The texts of a request that its operator does not control: all but system messages, trimmed, without empty ones.

    messages: structs of role and content; content is a text, or a JSON list of parts with text or content.
    """
    foreign = F.filter(messages, lambda m: F.lower(F.coalesce(m["role"], F.lit(""))) != "system")
    parts = lambda c: F.transform(F.from_json(c, "array<struct<text:string,content:string>>"), lambda p: F.coalesce(F.nullif(p["text"], F.lit("")), p["content"], F.lit("")))
    texts = F.flatten(F.transform(foreign, lambda m: F.when(F.substring(F.ltrim(m["content"]), 1, 2).isin("[{", "[]"), F.coalesce(parts(m["content"]), F.array(m["content"]))).otherwise(F.array(m["content"]))))
    return F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t.isNotNull() & (t != ""))


def classified(text: Column, model: Callable[[pd.Series], pd.Series] | None = None, threshold: float = 0.5) -> Column:
    """Score and label of a classifier, which maps a series of texts to scores; without one the scan goes on with 0 and safe."""
    score = F.lit(0.0) if model is None else F.coalesce(F.pandas_udf(model, "double")(text), F.lit(0.0))
    kind = F.when(score >= threshold, "malicious").when(score >= SUSPICIOUS * threshold, "suspicious").otherwise("safe")
    return F.struct(score.alias("score"), kind.alias("label"))


def scanned(requests: DataFrame, key: str = "request_id", model: Callable[[pd.Series], pd.Series] | None = None, alert: float = 0.5, block: float = 0.8, phrases: tuple[str, ...] = text_scans.PHRASES) -> DataFrame:
    """One row per request: injection_score, injection_label, structural_score, encoding_score, encodings, segments_scanned, credential_count and classifier_score.

    requests: the key and messages. Each segment is made plain, then scored; the worst segment counts. Encodings add to what room the score leaves, and so does a classifier, which
    then takes the place of phrases: these only bear out a score of CORROBORATED or more. A request without such segments scores 0; credentials count in all its messages.
    """
    all_text = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    found = F.size(text_scans.matched(all_text, text_scans.CREDENTIALS))
    rows = requests.select(F.col(key), found.alias("credential_count"), F.posexplode_outer(segments(F.col("messages"))).alias("place", "segment"))
    rows = rows.withColumn("n", deep_scans.normalize(F.col("segment"))).withColumn("s", text_scans.signals(F.col("n.normalized"), phrases))
    worst = F.max_by("s", F.struct("s.score", -F.col("place")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("place", F.col("n.normalized").alias("text"), F.col("n.encodings").alias("encodings"), F.round("s.score", 4).alias("score"), F.col("s.delimiter_hits").alias("delimiter_hits"))))), lambda x: x)
    out = rows.groupBy(key).agg(F.first("credential_count").alias("credential_count"), F.count("segment").alias("segments_scanned"), F.coalesce(F.max(F.when(F.col("segment").isNotNull(), F.col("n.score"))), F.lit(0.0)).alias("e"), worst.alias("w"), listed.alias("parts"))
    none = F.col("segments_scanned") == 0
    value = lambda f: F.when(none, 0.0).otherwise(F.col("w")[f])
    base = value("score") if model is None else value("token")
    fused = F.least(F.lit(1.0), base + F.col("e") * (1 - base))
    out = out.withColumn("encodings", F.array_distinct(F.flatten(F.transform("parts", lambda p: p["encodings"]))))
    if model is not None:
        joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
        ends = [classified(F.substring(joined, 1, WINDOW), model)["score"], classified(F.when(F.length(joined) > WINDOW, F.substring(joined, -WINDOW, WINDOW)).otherwise(""), model)["score"]]
        out = out.withColumn("c", F.greatest(*ends))
        own = F.when((F.col("c") >= CORROBORATED) & (value("phrase") > 0), F.greatest("c", (F.col("c") + value("phrase")) / 2)).otherwise(F.col("c"))
    else:
        own = F.lit(0.0)
    score = F.least(F.lit(1.0), fused + own * (1 - fused))
    return out.select(
        key, score.alias("injection_score"), text_scans.label(score, alert, block).alias("injection_label"), value("score").alias("structural_score"), F.col("e").alias("encoding_score"), "encodings", "segments_scanned", "credential_count", own.alias("classifier_score"),
        F.transform(F.slice("parts", 1, 5), lambda p: F.struct(p["score"].alias("score"), text_scans.label(p["score"], alert, block).alias("label"), p["delimiter_hits"].alias("delimiter_hits"))).alias("first_segments"),
    )


def scan_event(scans: DataFrame, key: str = "request_id") -> DataFrame:
    """The scan as the JSON that an event carries: scores to four places and the first five segments."""
    four = lambda c: F.round(c, 4).alias(c)
    body = F.struct(four("injection_score"), "injection_label", (F.col("credential_count") > 0).alias("credential_detected"), "credential_count", F.col("encodings").alias("encoding_detected"), four("encoding_score"), four("structural_score"), "segments_scanned", F.col("first_segments").alias("segments"))
    return scans.select(key, F.to_json(body).alias("security"))
