"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a lexicon (stated seed words and words that the labelled
sample shows to be toxic), how near its hits are to the second person, capitals, punctuation, and
obfuscation (letters mixed with digits or marks, and hits found after undoing that). Spark ML's
trees are fitted to one part of a bounded sample of labelled rows and its isotonic regression to the other.

Null texts count as empty; they get the score of a text without words. Repeated rows are scored alike. Labels other than 0
and 1, and labels of unknown documents, are left out; several labels of one document count as toxic if any
does. Rows with a null id are scored, learn from no label and have a null held_out. Without labels of both kinds every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.llm.common import release, ship, written

#: Insults in four languages, and forms of the second person.
SEED = "idiot idiots moron morons stupid loser losers trash scum clown worthless pathetic disgusting dumb fool imbecile jerk bastard idiote crétin débile connard ordure minable abruti dummkopf trottel arschloch abschaum blödmann versager estúpido imbécil basura escoria payaso inútil patético asqueroso"
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti tus usted ustedes vosotros"
#: Letters that digits and marks stand for.
PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_SEED, _SECOND = frozenset(w.encode() for w in SEED.split()), frozenset(w.encode() for w in SECOND.split())
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARK = bytes(c for c in range(256) if c not in _MARKS)
_SHOUTED = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![a-z])")
_MIXED = re.compile(rb"[a-z]+[0-9@$!*_.-]+[a-z0-9@$!*_.-]*[a-z]")
NAMES = ("lexicon_density", "lexicon_kinds", "learnt_density", "learnt_weight", "learnt_most", "near_second", "second_density", "capitals", "shouted", "marks", "exclaims", "mixed", "mixed_hits", "log_words")
#: Words to each side of a hit that count as near it.
NEAR = 4


def features(text: str | None, learnt: dict[bytes, float]) -> list[float]:
    """The dense features of one whole text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "replace")
    low = raw.decode("utf-8", "replace").lower().encode() if not raw.isascii() else raw.lower()
    words = low.translate(_SPACED).split()
    n, size = max(1, len(words)), max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in _SEED]
    taught = [learnt[w] for w in words if w in learnt] if learnt else []
    second = [i for i, w in enumerate(words) if w in _SECOND]
    near = 0
    if hits and second:
        at = set(second)
        near = sum(any(j in at for j in range(i - NEAR, i + NEAR + 1)) for i in hits)
    mixed = _MIXED.findall(low)
    undone = sum((p := m.translate(PLAIN, b"*_.-")) in _SEED or p in learnt for m in mixed)
    return [
        len(hits) / n,
        float(len({words[i] for i in hits})),
        len(taught) / n,
        min(50.0, sum(taught)),
        max(taught, default=0.0),
        near / max(1, len(hits)),
        len(second) / n,
        len(raw.translate(None, _NOT_CAPITAL)) / size,
        len(_SHOUTED.findall(raw)) / n,
        len(raw.translate(None, _NOT_MARK)) / size,
        raw.count(b"!") / n,
        len(mixed) / n,
        undone / n,
        math.log1p(len(words)),
    ]


def feature_column(text: Column, learnt: dict[bytes, float]) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([features(t, learnt) for t in texts])
        release()
        return out

    return F.pandas_udf(run, "array<double>")(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Toxicity:
    learnt: dict[bytes, float] = field(default_factory=dict)
    trees: object = None
    calibration: object = None
    prior: float = 0.0
    threshold: float = 0.7

    def _scored(self, docs: DataFrame, text_col: str) -> DataFrame:
        """_row (a struct of the columns of docs) and _score."""
        ship(docs.sparkSession)
        whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
        if self.trees is None:
            return docs.select(whole, F.lit(self.prior).alias("_score"))
        rows = docs.select(whole, array_to_vector(feature_column(docs[text_col].cast("string"), self.learnt)).alias("_tox_features"))
        rows = self.trees.transform(rows).select("_row", vector_to_array("probability")[1].alias("_tox_p"))
        return self.calibration.transform(rows).select("_row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_tox_score"))).alias("_score"))

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with score (0 to 1) and predicted (1 at the threshold or over); rows and columns stay (but for columns of these two names)."""
        kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")]
        return self._scored(docs, text_col).select(*kept, F.col("_score").alias("score"), (F.col("_score") >= self.threshold).cast("int").alias("predicted"))

    def accepted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of docs below the threshold, their columns unchanged whatever their names."""
        return self._scored(docs, text_col).where(F.col("_score") < self.threshold).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, lexicon: int = 200, trees: int = 30, depth: int = 3, threshold: float = 0.7, seed: int = 7) -> Toxicity:
    """Fits lexicon, trees and calibration to at most `sample` labelled rows outside the held-out fold, drawn by a hash of their id."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(labels["toxic"].isin(0, 1) & ~held_out(labels["doc_id"])).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("_label"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)  # at most `sample` rows of 16 bytes
    drawn = drawn.select(F.col("doc_id").alias("_id"), "_label")
    texts = docs.select(docs["doc_id"].alias("_doc"), docs["text"].cast("string").alias("_text"))
    rows = written(texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text"), "toxicity-sample")
    totals = rows.agg(F.sum("_label").alias("bad"), F.count("*").alias("n")).first()
    bad, n = totals["bad"] or 0, totals["n"]
    if not bad or bad == n:
        return Toxicity(threshold=threshold)
    spaced = F.regexp_replace(F.lower("_text"), r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", " ")
    seen = rows.select("_label", F.explode(F.array_distinct(F.split(spaced, r"\s+"))).alias("word")).groupBy("word").agg(F.sum("_label").alias("a"), F.count("*").alias("c"))
    rate_bad, rate_ok = (F.col("a") + 0.5) / (bad + 1), (F.col("c") - F.col("a") + 0.5) / (n - bad + 1)
    weight = F.log(rate_bad / rate_ok)
    strong = seen.where((F.col("a") >= 5) & (F.length("word") > 2)).select("word", weight.alias("w"), (weight / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") - F.col("a") + 0.5))).alias("z"))
    strong = strong.where("w > 1.0 AND z > 5").orderBy(F.desc("z"), "word").limit(lexicon)
    learnt = {r["word"].encode(): float(r["w"]) for r in strong.collect()}  # at most `lexicon` rows
    data = rows.select("_label", array_to_vector(feature_column(F.col("_text"), learnt)).alias("_tox_features"), (F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(4)) == 0).alias("_calibrates"))
    data = written(data, "toxicity-features")
    fitting, checking = data.where("NOT _calibrates"), data.where("_calibrates")
    kinds = [x.agg(F.countDistinct("_label")).first()[0] for x in (fitting, checking)]
    if kinds[0] < 2:
        return Toxicity(prior=0.0, threshold=threshold)
    model = GBTClassifier(labelCol="_label", featuresCol="_tox_features", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=5, maxBins=64, seed=seed).fit(fitting.coalesce(2))
    checked = model.transform(checking if kinds[1] == 2 else fitting).select("_label", vector_to_array("probability")[1].alias("_tox_p"))
    curve = IsotonicRegression(labelCol="_label", featuresCol="_tox_p", predictionCol="_tox_score").fit(checked.coalesce(1))
    return Toxicity(learnt, model, curve, threshold=threshold)
