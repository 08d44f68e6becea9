"""Exact top-k inner products by branch and bound over ball trees.

Vectors are dealt into shards of bounded size; each shard builds its ball tree once, and the trees are written as rows. A first round takes the most
promising leaf of a few shards for each query; the k-th best score found there is a bound that all
shards then share. In the second round every shard visits its nodes in the order of their upper bound
(centre's inner product plus radius times the query's norm) and leaves out those below the current k-th score.
A shard reads the queries block by block from the shared folder, so a node is weighed for many queries at once, and neither vectors nor queries are shuffled
more than once; what is shuffled besides are candidates that reach the bound. Scores are exact integers.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A shorter vector counts as
padded with zeros. Ties go to the smaller id; a node is left out only if its bound is below the k-th score. Rows that share the query's id are not its
candidates; a repeated query is answered once, by its first vector in order of components. Fewer candidates than k give fewer rows, an empty table none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.llm.common import open_fs, ship, written

#: Numbers in a shard (20,000 vectors of 100), queries in a block, vectors in a leaf, and shards that a query asks first.
SHARD, GROUP, LEAF, FIRST = 2_000_000, 8192, 64, 8


def as_integers(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double"))))


class BallTree:
    """Nodes over rows of an integer matrix, split at the median along the widest spread. Rows lie in the order of the leaves."""

    PARTS = {"ids": np.int64, "rows": np.int64, "begin": np.int32, "end": np.int32, "child": np.int32, "centre": np.float64, "radius": np.float64}

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def built(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(rows))
        x = rows.astype(np.float64)
        begin, end, child, centre, radius = [], [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            a, z, parent = todo.pop()
            node = len(begin)
            if parent >= 0:
                child[parent][child[parent].index(-1)] = node
            own = x[order[a:z]]
            c = own.mean(axis=0)
            centre.append(c)
            radius.append(np.sqrt(((own - c) ** 2).sum(axis=1).max()))
            begin.append(a)
            end.append(z)
            child.append([-1, -1])
            if z - a > leaf and radius[-1] > 0:
                axis = own.var(axis=0).argmax()
                cut = (z - a) // 2
                part = np.argpartition(own[:, axis], cut)
                order[a:z] = order[a:z][part]
                todo += [(a, a + cut, node), (a + cut, z, node)]
        return cls(ids=ids[order], rows=rows[order], begin=np.array(begin), end=np.array(end), child=np.array(child), centre=np.array(centre), radius=np.array(radius))

    def packed(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in self.PARTS.items()}

    @classmethod
    def unpacked(cls, parts: dict[str, bytes]) -> BallTree:
        got = {k: np.frombuffer(parts[k], kind) for k, kind in cls.PARTS.items()}
        nodes = len(got["begin"])
        return cls(**got | {"rows": got["rows"].reshape(len(got["ids"]), -1), "child": got["child"].reshape(nodes, 2), "centre": got["centre"].reshape(nodes, -1)})


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _matrix(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Vectors that lie one after another as the rows of a matrix, filled up with zeros."""
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def search(tree: BallTree, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, first_leaf: bool) -> tuple[list[int], list[int], list[int]]:
    """Queries, candidates and scores: the best candidates of one shard for each query, all that can matter or those of the first leaf. floor: what a score must reach."""
    width = max(q.shape[1], tree.rows.shape[1])
    rows, q = _wide(tree.rows, width), _wide(q, width)
    centre, qf = _wide(tree.centre, width), q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))
    best: list[list[tuple[int, int]]] = [[] for _ in qids]  # heaps of (score, -id)
    kth = floor.copy()

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        up = qf[who] @ centre[node] + tree.radius[node] * norm[who]
        return up + np.abs(up) * 1e-9 + 1e-6

    def leaf(node: int, who: np.ndarray) -> None:
        at = slice(tree.begin[node], tree.end[node])
        own, got = tree.ids[at], scores(q[who], rows[at])
        for i in np.flatnonzero((got >= kth[who, None]).any(axis=1)).tolist():
            w = who[i]
            heap = best[w]
            for j in np.flatnonzero(got[i] >= kth[w]).tolist():
                c = int(own[j])
                if c == qids[w]:
                    continue
                item = (int(got[i, j]), -c)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == k:
                kth[w] = max(kth[w], heap[0][0])

    if first_leaf:
        node_of = np.zeros(len(qids), np.int64)
        while (inner := np.unique(node_of[tree.child[node_of, 0] >= 0])).size:  # down to a leaf, always to the child with the higher bound
            for node in inner.tolist():
                who = np.flatnonzero(node_of == node)
                a, b = tree.child[node].tolist()
                node_of[who] = np.where(bound(a, who) >= bound(b, who), a, b)
        for node in np.unique(node_of).tolist():
            leaf(node, np.flatnonzero(node_of == node))
    else:
        todo = [(0.0, 0, np.arange(len(qids)))]
        while todo:
            _, node, who = heapq.heappop(todo)
            who = who[bound(node, who) >= kth[who]]
            if not len(who):
                continue
            if tree.child[node, 0] < 0:
                leaf(node, who)
                continue
            for c in tree.child[node].tolist():
                up = bound(c, who)
                on = up >= kth[who]
                if on.any():
                    heapq.heappush(todo, (-float((up - kth[who])[on].max() if np.isfinite(kth[who][on]).all() else up[on].max()), c, who[on]))
    found = [(int(qids[i]), -c, s) for i, heap in enumerate(best) for s, c in heap]
    return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _blocks(folder: str):
    """Ids, vectors, floors and numbers of the queries in a written table, block by block."""
    fs, base = open_fs(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
        if not info.path.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as f:
            for b in pq.ParquetFile(f).iter_batches(GROUP, columns=["vec_id", "v", "floor", "n"]):
                v = b.column("v")
                offsets = v.offsets.to_numpy()
                yield b.column("vec_id").to_numpy(), _matrix(v.values.to_numpy(), offsets, int(np.diff(offsets).max(initial=0))), b.column("floor").to_numpy(), b.column("n").to_numpy()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, first: int = FIRST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row that is_query selects. shard: numbers in one."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), as_integers(vectors[vector_col]).alias("v"), is_query.alias("_q")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    rows = written(rows.withColumn("_n", F.monotonically_increasing_id()), "vectors")  # rows are dealt by their number in the written table, so repeated ones spread too
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * max(1, width) // shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "_n"], kind="stable")
        offsets = np.concatenate([[0], np.cumsum(pdf["v"].map(len))]).astype(np.int64)
        tree = BallTree.built(pdf["vec_id"].to_numpy(), _matrix(np.concatenate(pdf["v"].to_list()).astype(np.int64), offsets, max(1, int(np.diff(offsets).max()))))
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **tree.packed()}])

    dealt = rows.select("vec_id", "v", "_n", F.pmod(F.xxhash64("_n"), F.lit(shards)).cast("int").alias("shard"))
    trees = written(dealt.groupBy("shard").applyInPandas(build, "shard int, " + ", ".join(f"{p} binary" for p in BallTree.PARTS)), "ball-trees")
    asked = rows.where("_q").groupBy("vec_id").agg(F.min("v").alias("v"))

    def one_round(queries: DataFrame, first_leaf: bool) -> DataFrame:
        folder = queries._written_to

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    number, tree = b.column("shard")[i].as_py(), BallTree.unpacked({p: b.column(p)[i].as_buffer() for p in BallTree.PARTS})
                    for qids, q, floor, n in _blocks(folder):
                        mine = np.flatnonzero((number - n) % shards < first) if first_leaf else slice(None)
                        found = search(tree, qids[mine], q[mine], floor[mine], k, first_leaf)
                        if found[0]:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

        return trees.repartition(shards, "shard").mapInArrow(run, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    number = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards))
    begun = written(asked.select("vec_id", "v", F.lit(float("-inf")).alias("floor"), number.alias("n")), "queries")
    low = best(one_round(begun, True)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("low"))
    bounded = written(begun.join(low, "vec_id", "left").select("vec_id", "v", F.coalesce("low", "floor").alias("floor"), "n"), "bounded-queries")
    return best(one_round(bounded, False)).select("query_id", "rank", "vec_id", "score")
