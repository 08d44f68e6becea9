"""Exact deduplication by content sort.

Spark samples splitters and range-partitions the rows by their normalised bytes (the first HEAD, then a hash of
all, so that splitters stay small) and then by id, so that a text with very many copies spreads over neighbouring partitions. Each partition is sorted
(externally, by Spark); equal texts are then adjacent and each is compared in full with its neighbour. A run of equal
texts at either end of a partition may go on in the next one: the texts of those runs, two for each
partition, are compared again across partitions.

Null texts count as empty ones, and empty texts are equal to each other. Of equal texts the row with the
largest (or, by choice, smallest) id stays; where that id itself is repeated, one of its rows is kept. A row with a null id stays only where no other row has its text. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.llm.common import row_key, rows_of, ship, tidy, written

#: Leading bytes of a text that splitters hold.
HEAD = 24
_SCHEMA = "doc_id long, part int, run long, keep_id long, group_size long, nth long, text_sha256 string, edge_text binary"


def groups(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    ship(docs.sparkSession)
    sign = {"largest": -1, "smallest": 1}[keep]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), _body(docs, text_col, normalise).alias("body"))
    rows = rows.withColumns({"head": F.substring("body", 1, HEAD), "mark": F.xxhash64("body")})  # the driver samples keys of bounded size, not whole texts
    by_id = F.col("doc_id").desc_nulls_last() if sign < 0 else F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange("head", "mark", by_id).sortWithinPartitions("head", "mark", "body", by_id).select("doc_id", "body")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        text, digest, ids = None, "", []

        def close(edge):
            """The rows of the run that has ended; the first of an edge run carries its text."""
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(ids[:1] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([digest] * n), pa.array([text if edge else None] + [None] * (n - 1), pa.binary())],
                ["doc_id", "part", "run", "keep_id", "group_size", "nth", "text_sha256", "edge_text"],
            )

        held, size = [], 0
        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                now = body.as_buffer()
                if text is not None and now.equals(text_buffer):
                    ids.append(doc)
                    continue
                if text is not None:
                    held.append(close(number == 0))
                    size += len(ids)
                    number += 1
                    if size >= 5000:
                        yield _joined(held)
                        held, size = [], 0
                text = now.to_pybytes()
                text_buffer = pa.py_buffer(text)
                digest, ids = hashlib.sha256(text).hexdigest(), [doc]
        if text is not None:
            held.append(close(True))
            yield _joined(held)

    found = written(rows.mapInArrow(tidy(run), _SCHEMA), "content-sort")
    edges = found.where(F.col("edge_text").isNotNull()).select("part", "run", "edge_text", "keep_id", "group_size")  # two rows a partition at most
    best = F.max("keep_id") if sign < 0 else F.min("keep_id")
    whole = edges.groupBy("edge_text").agg(best.alias("w_keep"), F.sum("group_size").alias("w_size"), F.min(F.struct("part", "run")).alias("w_first"))
    across = edges.join(whole, "edge_text").select("part", "run", "w_keep", "w_size", (F.struct("part", "run") == F.col("w_first")).alias("w_is_first"))
    out = found.drop("edge_text").join(F.broadcast(across), ["part", "run"], "left")  # two rows of numbers a partition at most
    keep_id, first = F.coalesce("w_keep", "keep_id"), F.coalesce("w_is_first", F.lit(True))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("w_size", "group_size").alias("group_size"),
        (first & (F.col("nth") == 0)).alias("kept"),
        "text_sha256",
    )


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text, also where its id is repeated or stands on other texts."""
    kept = groups(docs, **options).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"), F.lit(True).alias("_once"))
    return rows_of(docs, row_key(docs[options.get("id_col", "doc_id")].cast("long"), F.sha2(_body(docs, options.get("text_col", "text"), options.get("normalise")), 256)), kept)


def _body(docs: DataFrame, text_col: str, normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return (normalise(text) if normalise else text).cast("binary")
