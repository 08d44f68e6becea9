"""Merkle manifest of a dataset: parents keep the concatenated hashes of their children.

Every row is a leaf, the hash of its fields. Within a group (a source) leaves ascend by id, and every FANOUT consecutive nodes become one parent until one node is
left, the group's subroot; subroots, in the order of groups, become the root in the same way. A parent's preimage is the concatenation of its children's
hashes, 64 characters each, so it holds everything that a proof needs at its level: a leaf that has its ancestors' preimages finds its siblings by cutting its own 64
characters out of each (siblings), and a root is folded from another leaf by putting its hash in their place (fold).

Preimages go down the tree: each parent hands its own and those above it to at most FANOUT children, so no join meets more than FANOUT rows of a key, however many rows a group has.

Null fields count as `-`; rows without an id come first in their group, rows without a group form a group of their own, the first. Rows with the same id are ordered by their
hash; rows alike in all fields are leaves of their own. An empty table has no rows, no levels and no root. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.llm.common import positions, written

#: Children of a parent, and characters of a hash.
FANOUT, WIDTH = 16, 64


def field(value: Column) -> Column:
    """A value as hashed: `-` for null, else its bytes, a colon and the value. Never null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


@dataclass
class Manifest:
    """leaves: id, group, _group_key, leaf, _pos and what was carried. levels: of each level of the groups' trees, _group_key, _idx, preimage, hash. subroots: one row a group, with _pos. top: the levels of the tree of subroots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    fanout: int

    def root(self) -> str | None:
        """The root, None for an empty table."""
        if self.top:
            return self.top[-1].first()["hash"]
        one = self.subroots.select("subroot").first()
        return one and one["subroot"]


def build(docs: DataFrame, fields: list[Column], id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table. carry: more columns for the leaves, by name."""
    rows = docs.select(docs[id_col].alias("id"), docs[group_col].alias("group"), field(docs[group_col]).alias("_group_key"), leaf(fields).alias("leaf"), *[c.alias(n) for n, c in (carry or {}).items()])
    # the group's own order decides between groups only for subroots; here any order of groups will do
    leaves = positions(rows, [F.col("id").asc_nulls_first(), F.col("leaf")], "_group_key", "merkle-leaves")
    levels, alone = _levels(leaves.select("_group_key", "_pos", F.col("leaf").alias("hash")), fanout)
    roots = alone if not levels else alone.unionByName(_tops(levels))
    names = leaves.where("_pos = 0").select("_group_key", "group")
    subroots = positions(roots.join(names, "_group_key").withColumnRenamed("hash", "subroot"), [F.col("group").cast("string").asc_nulls_first()], name="merkle-subroots")
    top, _ = _levels(subroots.select(F.lit("").alias("_group_key"), "_pos", F.col("subroot").alias("hash")), fanout)
    return Manifest(leaves, levels, subroots, top, fanout)


def _levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents over nodes (_group_key, _pos, hash), the lowest first, and the nodes that are alone in their group."""
    levels: list[DataFrame] = []
    alone = None
    while True:
        level = nodes.groupBy("_group_key", F.floor(F.col("_pos") / fanout).alias("_idx")).agg(F.array_sort(F.collect_list(F.struct("_pos", "hash"))).alias("c"))
        level = written(level.select("_group_key", "_idx", F.size("c").alias("_n"), F.array_join(F.transform("c", lambda x: x["hash"]), "").alias("preimage")), "merkle-level")
        ended = (F.col("_idx") == 0) & (F.col("_n") == 1)  # one node was left in the group: it is its own subroot
        if alone is None:
            alone = level.where(ended).select("_group_key", F.col("preimage").alias("hash"))
        level = level.where(~ended).select("_group_key", "_idx", "preimage", digest(F.col("preimage")).alias("hash"))
        if level.isEmpty():
            return levels, alone
        levels.append(level)
        nodes = level.select("_group_key", F.col("_idx").alias("_pos"), "hash")


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The last parent of each group: _group_key, hash."""
    out = None
    for at, level in enumerate(levels):
        top = level.where("_idx = 0").select("_group_key", "hash")
        if at + 1 < len(levels):
            top = top.join(levels[at + 1].where("_idx = 0").select("_group_key"), "_group_key", "left_anti")
        out = top if out is None else out.unionByName(top)
    return out


def _paths(levels: list[DataFrame], fanout: int, above: DataFrame, extra: list[str]) -> DataFrame:
    """Of each parent of the lowest level, and of each group without parents (_idx 0, empty path): the preimages from its own up to its group's top, and the extra columns of above (by _group_key)."""
    empty = F.array().cast("array<string>").alias("path")
    path = above.select("_group_key", F.lit(0).cast("long").alias("_idx"), empty, *extra)  # what a group's top node hangs from
    for level in reversed(levels):
        up = path.select("_group_key", F.col("_idx").alias("_up"), F.col("path").alias("_above"), *extra)
        own = level.select("_group_key", "_idx", F.floor(F.col("_idx") / fanout).alias("_up"), "preimage")
        mine = own.join(up, ["_group_key", "_up"]).select("_group_key", "_idx", F.concat(F.array("preimage"), "_above").alias("path"), *extra)
        # a group whose tree is lower has no node here: what it hangs from goes on
        lower = path.where("_idx = 0 AND size(path) = 0").join(level.where("_idx = 0").select("_group_key"), "_group_key", "left_anti")
        path = written(mine.unionByName(lower), "merkle-paths")  # each level is read twice by the next
    return path


def paths(m: Manifest) -> DataFrame:
    """Every leaf with its ancestors' preimages: the leaves' columns, path (within its group, the lowest first), subroot, group_pos, group_path (above its subroot) and root."""
    top = m.subroots.select(F.lit("").alias("_group_key"), F.lit(m.root()).alias("root")).limit(1)
    ends = _paths(m.top, m.fanout, top, ["root"]).select(F.col("_idx").alias("_up"), F.col("path").alias("group_path"), "root")
    hung = m.subroots.select("_group_key", "subroot", F.col("_pos").alias("group_pos"), F.floor(F.col("_pos") / m.fanout).alias("_up")).join(ends, "_up").drop("_up")
    below = _paths(m.levels, m.fanout, hung, ["subroot", "group_pos", "group_path", "root"])
    return m.leaves.withColumn("_idx", F.floor(F.col("_pos") / m.fanout)).join(below, ["_group_key", "_idx"])


def _slot(pos: Column, level: Column, fanout: int) -> Column:
    return F.pmod(F.floor(pos / F.pow(F.lit(fanout), level)), F.lit(fanout)).cast("int")


def siblings(path: Column, pos: Column, fanout: int = FANOUT) -> Column:
    """The hashes of a node's siblings at each level, one after another: each preimage without the node's own slot."""
    cut = lambda pre, at: F.concat(F.substring(pre, F.lit(1), at * WIDTH), F.substring(pre, (at + 1) * WIDTH + 1, F.length(pre)))
    return F.array_join(F.transform(path, lambda pre, i: cut(pre, _slot(pos, i, fanout))), "")


def fold(start: Column, path: Column, pos: Column, fanout: int = FANOUT) -> Column:
    """The top that a hash leads to: put in its slot of each preimage in turn, and hashed."""
    steps = F.transform(path, lambda pre, i: F.struct(pre.alias("pre"), _slot(pos, i, fanout).alias("at")))
    put = lambda h, s: F.concat(F.substring(s["pre"], F.lit(1), s["at"] * WIDTH), h, F.substring(s["pre"], (s["at"] + 1) * WIDTH + 1, F.length(s["pre"])))
    return F.aggregate(steps, start, lambda h, s: F.sha2(put(h, s).cast("binary"), 256))


def proofs(m: Manifest, start: Column | None = None) -> DataFrame:
    """The leaves' columns, subroot, root, proof (siblings up to the root, one after another), folded_root (from start, or the leaf itself) and verified."""
    start = F.col("leaf") if start is None else start
    proof = F.concat(siblings(F.col("path"), F.col("_pos"), m.fanout), siblings(F.col("group_path"), F.col("group_pos"), m.fanout))
    folded = fold(fold(start, F.col("path"), F.col("_pos"), m.fanout), F.col("group_path"), F.col("group_pos"), m.fanout)
    kept = [c for c in m.leaves.columns if not c.startswith("_")]
    out = paths(m).select(*kept, "subroot", "root", proof.alias("proof"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
