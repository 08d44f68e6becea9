"""Importance resampling towards a target distribution, over hashed n-grams of words.

Texts become features, all runs of 1 to n consecutive words, and features fall into buckets by the crc32 of their bytes. How much more often a bucket
occurs in the target than in the corpus is its gain; a document weighs the mean gain of its features, and Gumbel noise from a hash of its id turns the
highest scores into a draw without replacement.

An integer dictionary makes it cheap: each block of texts (BLOCK bytes) maps its distinct words to ids, n-grams are tuples of ids, packed into integers where words are few
enough, each distinct tuple's bytes are put together and hashed once, and the counts of tuples and documents are joined back through the tuples' numbers. A block holds whole texts, or a piece
of a very long one that begins with the last words of the piece before, so that no n-gram is lost or counted twice.
Dictionaries are per block, not one for all: nearly all pairs of words are new in a large corpus, and a global one would shuffle every pair twice.

Null texts have no words. A document without words weighs 0; rows with the same id are drawn separately; a null id hashes as an empty one and comes last among ties. Without
target texts or documents all counts are 0 and gains come from the smoothing alone. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.llm.common import positions, ship, tidy, written

#: Bytes of text whose words share a dictionary.
BLOCK = 4_000_000
#: Bytes of words, in lower case: digits, ASCII letters and all of other characters. All else separates.
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        _LOWER[_c] = _c
    elif 0x41 <= _c <= 0x5A:
        _LOWER[_c] = _c + 32


class Block:
    """The words of some texts as ids: words (the distinct ones), ids in order, the text of each. fresh tells which words count here; the others only lead a piece of a long text."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, lead: np.ndarray):
        """data: bytes of the texts, one after another; begins: where each begins; lead: words at the start of each that belong to the piece before."""
        low = _LOWER[data]
        inside = low != 0
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        at = begins[begins < len(data)]
        starts[at] = inside[at]  # neighbouring texts don't share a word
        where = np.flatnonzero(starts)
        letters = low[inside]
        offsets = np.append((np.cumsum(inside, dtype=np.int64) - 1)[where], len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.words: pa.Array = words.dictionary
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.searchsorted(begins, where, side="right") - 1
        first = np.searchsorted(self.text, np.arange(len(begins)))
        self.fresh = np.arange(len(where)) - first[self.text] >= lead[self.text] if len(where) else np.zeros(0, bool)

    def features(self, n: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """For each length up to n: the text of each n-gram, the distinct tuples' bytes, and which tuple each n-gram is."""
        tuples, number = self.words, self.ids
        for k in range(1, n + 1):
            if k > 1:
                # a tuple is the number of its first k-1 words' tuple and its last word
                pairs, ok = number[:-1] * len(self.words) + self.ids[k - 1 :], self.text[: len(self.text) - k + 1] == self.text[k - 1 :]
                number, firsts = _numbered(pairs)
                seen = pairs[firsts]
                head, tail = seen // max(1, len(self.words)), seen % max(1, len(self.words))
                tuples = pc.binary_join_element_wise(tuples.take(pa.array(head)), self.words.take(pa.array(tail)), b" ")
            else:
                ok = np.ones(len(number), bool)
            counts = ok & self.fresh[k - 1 :]  # an n-gram belongs to the piece that holds its last word
            yield self.text[: len(counts)][counts], tuples, number[counts]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct value each one is, and where each distinct value first stands."""
    coded = pa.array(values).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.empty(len(coded.dictionary), np.int64)
    firsts[number[::-1]] = np.arange(len(number))[::-1]
    return number, firsts


def buckets(tuples: pa.Array, count: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tuples.to_pylist()), np.int64, len(tuples)) % count


def blocks(texts: pa.Array, n: int, size: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """Blocks of a batch of texts: the number of the first text, and the block; long texts are cut between words, and each piece leads with the n - 1 words before it."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        if offsets[end] - offsets[row] <= size:
            yield row, Block(data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row], np.zeros(end - row, np.int64))
        else:
            yield from ((row, Block(piece, np.zeros(1, np.int64), np.array([lead]))) for piece, lead in _pieces(data[offsets[row] : offsets[end]], n, size))
        row = end


def _pieces(data: np.ndarray, n: int, size: int) -> Iterator[tuple[np.ndarray, int]]:
    at, before = 0, []
    while at < len(data):
        end = at + size
        while end < len(data) and (gap := np.flatnonzero(_LOWER[data[end : end + size]] == 0)[:1]).size == 0:
            end += size
        end = end + int(gap[0]) if end < len(data) else len(data)
        piece = data[at:end]
        yield (np.concatenate([np.frombuffer(b" ".join([*before, b""]), np.uint8), piece]) if before else piece), len(before)
        before = (before + _LOWER[piece].tobytes().replace(b"\0", b" ").split())[-(n - 1) :] if n > 1 else []
        at = end


def bucket_counts(texts: DataFrame, n: int = 2, count: int = 10_000) -> DataFrame:
    """How often each bucket that occurs does: bucket, n. texts: one column. Each partition adds up its own blocks first."""
    ship(texts.sparkSession)

    def run(batches):
        total = np.zeros(count, np.int64)
        for b in batches:
            for _, block in blocks(b.column(0), n):
                for _, tuples, number in block.features(n):
                    total += np.bincount(buckets(tuples, count), weights=np.bincount(number, minlength=len(tuples)), minlength=count).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return texts.mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 2, count: int = 10_000) -> list[int]:
    """The gain of each bucket, in thousandths: floor(1000 ln of the ratio of smoothed shares). `count` rows come to the driver, whatever the corpus."""
    s, t = bucket_counts(docs, n, count).withColumnRenamed("n", "s"), bucket_counts(target, n, count).withColumnRenamed("n", "t")
    both = written(s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "importance-buckets")
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    of = np.zeros(count), np.zeros(count)
    for r in both.collect():  # at most `count` rows
        of[0][r["bucket"]], of[1][r["bucket"]] = r["s"], r["t"]
    ratio = (of[1] + 1) * (whole["s"] + count) / ((of[0] + 1) * (whole["t"] + count))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weighed(docs: DataFrame, gain: list[int], n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight (the floored mean gain of its features; 0 without any)."""
    ship(docs.sparkSession)
    of, count = np.array(gain, np.int64), len(gain)

    def run(batches):
        for b in batches:
            words, features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for row, block in blocks(b.column(1), n):
                for k, (text, tuples, number) in enumerate(block.features(n)):
                    text = text + row
                    if k == 0:
                        words += np.bincount(text, minlength=b.num_rows)
                    features += np.bincount(text, minlength=b.num_rows)
                    total += np.bincount(text, weights=of[buckets(tuples, count)][number], minlength=b.num_rows).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(1, features), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 8 hex digits of sha256(`seed:id`)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, count: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1, 2, 3, ... for the percent of the documents with enough words that are drawn, else null)."""
    gain = gains(docs.select(docs[text_col].cast("string")), target.select(target[text_col].cast("string")), n, count)
    rows = weighed(docs, gain, n, id_col, text_col)
    rows = rows.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("enough"))
    placed = positions(rows, [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight")], name="importance-scores")
    drawn = placed.where("enough").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_pos") < drawn, F.col("_pos") + 1).alias("rank"))
