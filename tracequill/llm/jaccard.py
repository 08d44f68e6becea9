"""Exact n-gram Jaccard self-join as a metric-space join, and the groups that its links form.

A document is the set of its word n-grams. Equal sets are one class from the start. Jaccard distance is a metric, and
a link is a distance of at most tau = 1 - threshold.

1. Pivots are classes. Nearly all pairs of documents are at distance 1 from each other, so pivots drawn at random would be
   equally far from everything and every document would be a boundary document of every region. The pivots that can be near
   a class are those that share one of its rarest n-grams: of the classes that have an n-gram among as many of their rarest ones as a linked set can
   lack (n - ceil(threshold * n)) and one more, the first (by a hash) is its pivot.
2. Regions. A class lies in the region of each pivot that its rarest n-grams lead to. Two linked sets share one of these n-grams, hence a
   pivot, so all links lie within regions. Copies of one text mostly have the same pivots.
3. A region of bounded size is joined in one task: distances to the pivot are exact, classes within tau are linked to it, and triangle-inequality
   windows of tau over the sorted distances part the rest, recursively. Pairs that are connected already aren't compared again.
4. A larger region is first joined with its pivot alone, by Spark: the classes within tau of it (its core) are linked to it. All links so far
   give groups, and the n-grams that led to large regions lead to new ones, in which groups stand for classes: the pivot of an n-gram is a class of the
   largest group that has it, another one each turn, and n-grams whose classes are all of one group are left out. A large group's many pivots thus become one, and
   its region holds the few classes that may yet join it. After TURNS such turns, the other classes of a region that is still large are compared with those of its
   group and with each other, in blocks of bounded size, by windows of tau over the distances to the pivot.
5. Links form groups by repeated smallest neighbours, in tables in the shared folder.

No candidate is dropped at any step. Which n-grams count as rare is settled by counts over all documents: those that occur once come first, the most
frequent ones (a bounded list) last. The order affects speed only. n-grams are compared as 64-bit hashes of their words, and equal sets
by 128 bits of a hash, so results are exact up to collisions of these.

Null, empty and blank texts have an empty set, are linked with nothing and form a group of their own. Texts with
fewer words than n are one n-gram, the whole sequence. Repeated rows have equal sets and are linked unless these are empty. Null ids come
after all others in a group's smallest. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.llm.bpe import slices
from tracequill.llm.common import discard, row_key, rows_of, ship, tidy, written

#: n-grams known as frequent at most, and how often one must occur to count as frequent.
FREQUENT, REPORTED = 65_536, 4
#: Classes and n-grams of a region that one task joins; larger regions are joined by several.
AREA_CLASSES, AREA_GRAMS = 1024, 1_000_000
#: How often what lies outside the cores of large regions gets new pivots.
TURNS = 3
#: Parts of a hot key in joins with one row per key.
SALTS = 64
#: The id of classes whose documents all have null ids.
LAST = (1 << 63) - 1
#: Bits of the bitmaps that spare rows a shuffle (16 MB and 8 MB, whatever the input); an exact join follows each.
GRAM_BITS, ID_BITS = 27, 26
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, n: int, words: dict) -> np.ndarray:
    """The sorted distinct n-gram hashes of one whole text (A-Z lower-cased; words part at space and \\t to \\r)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _K + h[i : len(h) - k + 1 + i])
    return np.unique(out.view(np.int64))


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    d = xxhash.xxh3_128_digest(grams.tobytes())
    a, b = np.frombuffer(d, "<i8")
    return int(a), int(b)


def need(n: int, percent: int) -> int:
    """The smallest overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _per_batch(b: pa.RecordBatch, n: int, words: dict):
    for s in slices(b):
        yield s, [shingles(t, n, words) for t in s.column(1).to_pylist()]


def counted(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """What all documents say about n-grams: a bitmap of those that occur more than once, and the most frequent ones, the most frequent last.

    n-grams travel as their first 40 bits, sorted, by bucket of values, as differences in planes of bytes (some 3 bytes each). A bucket is
    counted in one task; buckets grow in number with spark.sql.shuffle.partitions. Both results have a proven bound. They only rank n-grams, so values that
    coincide cost time, never a link.
    """
    spark = docs.sparkSession
    bits = max(6, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def pack(batches):
        words = _Words()
        for b in batches:
            for _, sets in _per_batch(b, n, words):
                v = np.sort(np.concatenate([*sets, np.zeros(0, np.int64)]).view(np.uint64) >> np.uint64(24))
                if not len(v):
                    continue
                bucket = (v >> np.uint64(40 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                d = np.diff(v, prepend=np.uint64(0))
                d[cut] = v[cut]
                planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                blobs = [np.ascontiguousarray(x.T).tobytes() for x in np.split(planes, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def count(table: pa.Table) -> pa.Table:
        values = []
        for blob in table.column("blob"):
            x = np.frombuffer(blob.as_buffer(), np.uint8).reshape(5, -1)
            d = np.zeros((x.shape[1], 8), np.uint8)
            d[:, :5] = x.T
            values.append(np.cumsum(d.view("<u8").ravel()))
        v, c = np.unique(np.concatenate(values), return_counts=True)
        many = c > 1
        v, c = v[many].astype(np.int64), c[many]
        top = np.argsort(c, kind="stable")[::-1][:FREQUENT]
        top = top[c[top] >= REPORTED]
        at = np.unique(v >> 40 - GRAM_BITS)  # by leading bits: a bucket has its own stretch of the bitmap
        part = at >> 15
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        maps = []
        for x in np.split(at, cut[1:]) if len(at) else []:
            m = np.zeros(32768, np.uint8)
            m[x & 32767] = 1
            maps.append(np.packbits(m, bitorder="little").tobytes())
        n_maps, n_top = len(maps), len(top)
        return pa.table({"part": pa.array([*part[cut].tolist(), *[None] * n_top], pa.int64()), "bits": pa.array([*maps, *[None] * n_top], pa.binary()), "gram": pa.array([*[None] * n_maps, *v[top].tolist()], pa.int64()), "c": pa.array([*[None] * n_maps, *c[top].tolist()], pa.int64())})

    packed = _texts(docs, id_col, text_col).mapInArrow(tidy(pack), "bucket long, blob binary")
    found = written(packed.groupBy("bucket").applyInArrow(count, "part long, bits binary, gram long, c long"), "jaccard-counts")
    maps = found.where("part IS NOT NULL").groupBy("part").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    bitmap = np.zeros((1 << GRAM_BITS) // 8, np.uint8)
    for r in maps.toLocalIterator():  # 16 MB in all, whatever the input
        bitmap[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    top = found.where("gram IS NOT NULL").orderBy(F.desc("c"), "gram").limit(FREQUENT).select("gram")
    common = np.array([r[0] for r in top.toLocalIterator()][::-1], np.int64)
    discard(found)
    return bitmap, common


def described(docs: DataFrame, n: int, percent: int, bitmap: np.ndarray, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> tuple[DataFrame, Broadcast]:
    """doc_id, n_shingles, c (the class of its set), rare (those of its rarest n-grams that occur more than once), if asked for mark (a hash of its text): one row per document. With them the broadcast that they need.
    """
    by_gram = np.argsort(common)
    held = docs.sparkSession.sparkContext.broadcast((bitmap, common[by_gram], by_gram))

    def run(batches):
        words = _Words()
        bitmap, sorted_common, by_gram = held.value
        for b in batches:
            for s, sets in _per_batch(b, n, words):
                a, z, firsts = [], [], []
                for g in sets:
                    x, y = signature(g)
                    a.append(x)
                    z.append(y)
                    take = len(g) - need(len(g), percent) + 1 if len(g) else 0
                    short = (g.view(np.uint64) >> np.uint64(24)).astype(np.int64)
                    shared = _in(bitmap, short >> 40 - GRAM_BITS)
                    single = np.flatnonzero(~shared)
                    take -= len(single)  # no other document has these
                    if take <= 0:
                        firsts.append(g[:0])
                        continue
                    left = np.flatnonzero(shared)
                    if len(sorted_common):
                        at = np.minimum(np.searchsorted(sorted_common, short[left]), len(sorted_common) - 1)
                        rank = np.where(sorted_common[at] == short[left], by_gram[at] + 2, 1)
                        left = left[np.argsort(rank, kind="stable")]
                    firsts.append(g[left[:take]])
                off = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64)))
                c = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([len(g) for g in sets], pa.int64()), c, lists, *s.columns[2:]], ["doc_id", "n_shingles", "c", "rare", "mark"][: 4 + marked])

    texts = _texts(docs, id_col, text_col)
    texts = texts.withColumn("mark", F.xxhash64("text")) if marked else texts
    return texts.mapInArrow(tidy(run), "doc_id long, n_shingles long, c struct<a:long,b:long>, rare array<long>" + ", mark long" * marked), held


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the links (u, v): large-star and small-star steps until nothing changes."""
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, step = state, step + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        last, edges = edges, written(small, f"{name}-{step}")
        discard(last)
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())


def _bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of so many bits, as bytes, of the column `at`."""
    parts = positions.groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits"))
    out = np.zeros(max(1, (1 << bits) // 32768) * 4096, np.uint8)
    for r in parts.toLocalIterator():
        b = np.frombuffer(r["bits"], np.uint8)
        begin = (r["part"] - 1) * 4096
        out[begin : begin + len(b)] = b
    return out


def _in(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _beside(rows: DataFrame, per_area: DataFrame) -> DataFrame:
    """rows of areas, which may be hot, with the one row of their area in per_area."""
    each = per_area.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", _salt("c")).join(each, ["area", "_salt"]).drop("_salt")


def _rank(turn: int) -> Column:
    """The order of groups in a turn: larger ones first, then by hash. Classes without a label are groups of their own."""
    return F.struct((-F.coalesce("size", F.lit(1))).alias("less"), F.xxhash64(F.lit(turn), F.coalesce("label", F.xxhash64("c"))).alias("h"))


def _regions(members: DataFrame, turn: int = 0) -> DataFrame:
    """area (the hash of a pivot's group), c, label, size, keys: each class in the regions of the pivots that its n-grams (keys) lead to, with those n-grams.

    The pivot of an n-gram is of the first of the groups that have it. A label names the group that a class is known to be of, size counts its classes; n-grams whose classes all have one label are left out.
    n-grams are counted in salted parts, so a hot one is nowhere in one task.
    """
    rows = members.select("c", "label", "size", F.explode("keys").alias("gram")).withColumn("salt", _salt("c"))
    counts = [F.sum("m").alias("m"), F.sum("known").alias("known"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")]
    parts = rows.groupBy("gram", "salt").agg(F.min(_rank(turn)).alias("first"), F.count("*").alias("m"), F.count("label").alias("known"), F.min("label").alias("low"), F.max("label").alias("high"))
    led = parts.groupBy("gram").agg(*counts, F.collect_list("salt").alias("salts")).where("m > 1 AND NOT (known = m AND low = high)")
    led = led.select("gram", F.col("first.h").alias("area"), F.explode("salts").alias("salt"))
    return rows.join(led, ["gram", "salt"]).groupBy("area", "c").agg(F.first("label").alias("label"), F.first("size").alias("size"), F.collect_list("gram").alias("keys"))


def _distance_to(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.struct(both.cast("long").alias("both"), (F.size(a) + F.size(b) - both).cast("long").alias("any"))


class _Area:
    """The classes of one area in a task: sets, groups by the links so far (a group is named by its first class), and distances."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.tau = percent, 1 - percent / 100
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.root = np.arange(len(sets))
        known, self.grams = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
        self.mark = np.zeros(len(known), np.int32)

    def find(self, i: int) -> int:
        return int(self.root[i])

    def join(self, members: np.ndarray) -> None:
        """Makes one group of those of the members."""
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def overlaps(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the intersections of i with the others, and of the unions. Sets are not empty."""
        own = self.grams[self.ends[i] - self.sizes[i] : self.ends[i]]
        self.mark[own] = 1
        if 8 * len(others) > len(self.sizes):
            both = np.add.reduceat(self.mark[self.grams], self.ends - self.sizes)[others]
        else:
            both = np.array([self.mark[self.grams[self.ends[j] - self.sizes[j] : self.ends[j]]].sum() for j in others.tolist()], np.int64)
        self.mark[own] = 0
        return both, self.sizes[i] + self.sizes[others] - both

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that i links to."""
        both, union = self.overlaps(i, others)
        return others[100 * both.astype(np.int64) >= self.percent * union]

    def solve(self, members: list[int]) -> None:
        """All links among the members, up to connection: a pivot, then the windows of the sorted distances to it."""
        todo = [np.asarray(members)]
        while todo:
            rest = todo.pop()
            found, first, count = np.unique(self.root[rest], return_index=True, return_counts=True)
            if len(found) < 2:
                continue
            # pairs within the largest group are settled; while there is none, the first is the pivot
            at = int(first.min()) if len(found) == len(rest) else int(np.flatnonzero(self.root[rest] != found[count.argmax()])[0])
            pivot, others = int(rest[at]), np.delete(rest, at)
            both, union = self.overlaps(pivot, others)
            self.join(np.append(others[100 * both.astype(np.int64) >= self.percent * union], pivot))
            d = 1 - both / union
            order = np.argsort(d, kind="stable")
            todo.extend(np.split(others[order], np.flatnonzero(np.diff(d[order]) > self.tau + 1e-9) + 1))


#: A class as columns (its first id and its hash), and links as pairs of these.
_CLASS = ["id", "a", "b"]
_LINKS = "ui long, ua long, ub long, vi long, va long, vb long"


def _pairs(pdf: pd.DataFrame, area: _Area) -> pd.DataFrame:
    """Each class with the first of its group."""
    moved = np.flatnonzero(area.root != np.arange(len(pdf)))
    return pd.DataFrame({f"{side}{k[0]}": pdf[k].to_numpy()[at] for side, at in (("u", moved), ("v", area.root[moved])) for k in _CLASS})


def _sets_of(pdf: pd.DataFrame, percent: int) -> _Area:
    """The classes of a task; those of one label are of one group from the start."""
    area = _Area([np.asarray(g, np.int64) for g in pdf["grams"]], percent)
    for same in pdf.groupby("label").indices.values() if pdf["label"].notna().any() else ():
        area.root[same] = same.min()
    return area


def _as_links(found: DataFrame) -> DataFrame:
    return found.select(*[F.struct(*[F.col(f"{side}{k[0]}").alias(k) for k in _CLASS]).alias(side) for side in "uv"])


def _links_of_areas(areas: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Links of whole areas, each in one task: the pivot's distances, then windows, recursively."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["less", "h", *_CLASS], kind="stable").reset_index(drop=True)  # the pivot first
        area = _sets_of(pdf, percent)
        area.solve(list(range(len(pdf))))
        return _pairs(pdf, area)

    flat = areas.select("area", "label", _rank(turn).alias("rank"), "c", "grams").select("area", "label", "rank.*", "c.*", "grams")
    return _as_links(flat.groupBy("area").applyInPandas(solve, _LINKS))


def _blocks(core: DataFrame, outer: DataFrame, percent: int, is_core: bool = True) -> DataFrame:
    """Links between two sides of each area, in blocks of bounded size, by windows over d, the distances to its pivot.

    is_core: the first side is one group, and each class of the other side that links to it gives one row, with that class as u. Else both sides are the same classes.
    """
    size = max(1, AREA_CLASSES)
    count = lambda df: df.groupBy("area").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    both = count(core).withColumnRenamed("n", "i").join(count(outer).withColumnRenamed("n", "j"), "area")

    def numbered(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        # a block number by hash: even blocks of about `size`, without an order over the whole area
        rows = _beside(df, both).withColumn(own, F.pmod(F.xxhash64(F.lit(7), "c"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        rows = rows if is_core else rows.where("i <= j")
        return rows.select(F.struct("area", "i", "j").alias("key"), F.lit(side).alias("side"), "label", "c.*", "grams", "d")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        area = _sets_of(pdf, percent)
        d = pdf["d"].to_numpy()
        inner = np.flatnonzero(pdf["side"] == 0)
        inner = inner[np.argsort(d[inner], kind="stable")]
        near = d[inner]
        reached = []
        for y in np.flatnonzero(pdf["side"] == 1).tolist():
            window = inner[np.searchsorted(near, d[y] - area.tau - 1e-9) : np.searchsorted(near, d[y] + area.tau + 1e-9, "right")]
            if not is_core:
                window = window[area.root[window] != area.root[y]]
            if not len(window):
                continue
            hits = area.linked(y, window)
            if is_core:
                reached.extend((y, i) for i in hits[:1].tolist())  # the core is one group, so one link tells all
            else:
                area.join(np.append(hits, y))
        if not is_core:
            return _pairs(pdf, area)
        at = np.array(reached, np.int64).reshape(-1, 2).T
        return pd.DataFrame({f"{side}{k[0]}": pdf[k].to_numpy()[x] for side, x in zip("uv", at, strict=True) for k in _CLASS})

    rows = numbered(core, "i", "j", 0).unionAll(numbered(outer, "j", "i", 1))
    return _as_links(rows.groupBy("key").applyInPandas(compare, _LINKS))


def groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links): one row per document."""
    return _rooted(docs, n, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """wanted (c, with its first id) with grams, from the whole texts again; a bitmap of ids spares the other rows the shuffle."""
    spark = docs.sparkSession
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    held = spark.sparkContext.broadcast(_bitmap(wanted.select(place(F.col("c.id")).alias("at")), ID_BITS))

    def sets(batches):
        words, bitmap = _Words(), held.value
        for b in batches:
            b = b.filter(pa.array(_in(bitmap, b.column(2).to_numpy())))
            for s, grams in _per_batch(b, n, words):
                sig = [signature(g) for g in grams]
                off = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                c = pa.StructArray.from_arrays([s.column(0), pa.array([x for x, _ in sig], pa.int64()), pa.array([y for _, y in sig], pa.int64())], _CLASS)
                yield pa.RecordBatch.from_arrays([c, pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)))], ["c", "grams"])

    texts = _texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    grams = texts.withColumn("at", place(F.col("doc_id"))).mapInArrow(tidy(sets), "c struct<id:long,a:long,b:long>, grams array<long>")
    found = written(wanted.join(grams, "c").dropDuplicates(["c"]).withColumn("n", F.size("grams")), "jaccard-sets")
    held.destroy()
    return found


def _links(sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of links (u, v) between the classes of sets (c, keys, grams, n)."""
    found: list[DataFrame] = []
    members = sets.select("c", "keys", F.lit(None).cast("long").alias("label"), F.lit(None).cast("long").alias("size"))
    for turn in range(TURNS + 1):
        regions = written(_regions(members, turn), f"jaccard-regions-{turn}")
        pivot = F.min(F.struct(_rank(turn).alias("rank"), F.xxhash64(F.lit(turn), "c").alias("h"), "c"))
        sizes = regions.join(sets.select("c", "n"), "c").groupBy("area").agg(F.count("*").alias("classes"), F.sum("n").alias("total"), pivot["c"].alias("pivot"))
        big = written(sizes.where((F.col("classes") > AREA_CLASSES) | (F.col("total") > AREA_GRAMS) & (F.col("classes") > 2)).select("area", "pivot"), f"jaccard-big-{turn}")
        each = big.select("area", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("big"))
        marked = regions.withColumn("_salt", _salt("c")).join(each, ["area", "_salt"], "left").drop("_salt")
        grams = sets.select("c", "grams")
        found.append(written(_links_of_areas(marked.where("big IS NULL").join(grams, "c"), percent, turn), f"jaccard-links-{turn}"))
        if big.isEmpty():
            break
        large = marked.where("big").drop("big")
        pivots = big.join(grams.select(F.col("c").alias("pivot"), F.col("grams").alias("p_grams")), "pivot")
        near = _beside(large.join(grams, "c"), pivots).withColumn("o", _distance_to(F.col("grams"), F.col("p_grams")))
        near = near.withColumns({"d": 1 - F.col("o.both") / F.col("o.any"), "core": F.col("o.both") * 100 >= F.col("o.any") * percent}).drop("p_grams", "o")
        if turn < TURNS:
            near = written(near.drop("grams"), f"jaccard-near-{turn}")
            found.append(near.where("core").select(F.col("c").alias("u"), F.col("pivot").alias("v")).where("u != v"))
            root = written(components(_all(found), f"jaccard-known-{turn}"), f"jaccard-groups-{turn}")
            many = root.groupBy("root").agg(F.count("*").alias("size"))
            known = root.join(many, "root").select(F.col("node").alias("c"), F.xxhash64("root").alias("label"), "size")
            members = near.select("c", "keys").join(known, "c", "left")
            continue
        # what is left: the other classes of an area beside those of its group, and beside each other
        near = written(near.withColumn("own", (F.col("label").isNotNull() & (_rank(turn)["h"] == F.col("area"))) | (F.col("c") == F.col("pivot"))), "jaccard-rest")
        outer = near.where("NOT own")
        found.append(near.where("core").select(F.col("c").alias("u"), F.col("pivot").alias("v")).where("u != v"))
        found.append(written(_blocks(near.where("own"), outer, percent), "jaccard-border"))
        found.append(written(_blocks(outer, outer, percent, is_core=False), "jaccard-rest-links"))
    return found


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionAll(x)
    return out


def _rooted(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, marked: bool = False) -> DataFrame:
    """The columns of groups() with root, the group itself (null without words), and if asked for mark, a hash of the text."""
    ship(docs.sparkSession)
    rows, held = described(docs, n, percent, *counted(docs, n, id_col, text_col), id_col, text_col, marked)
    rows = written(rows, "jaccard-documents")
    held.destroy()
    rows = rows.withColumn("salt", _salt("doc_id"))
    by_class = rows.where("n_shingles > 0").groupBy(F.col("c").alias("set"))
    classes = by_class.agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("id"), F.first("rare").alias("keys"), F.collect_set("salt").alias("salts"))
    classes = written(classes.select(F.struct("id", "set.a", "set.b").alias("c"), "keys", "salts"), "jaccard-classes")
    sets = _sets(docs, _met(classes), n, id_col, text_col)
    root = components(_all(_links(sets, percent)), "jaccard-links").select(F.col("node").alias("c"), "root")
    named = classes.join(root, "c", "left").select(F.struct("c.a", "c.b").alias("c"), F.coalesce("root", "c").alias("root"), F.explode("salts").alias("salt"))
    smallest = F.when(F.col("root.id") != LAST, F.col("root.id")).otherwise(F.col("doc_id"))
    return rows.join(named, ["c", "salt"], "left").select("doc_id", "n_shingles", F.coalesce(smallest, "doc_id").alias("component_id"), "root", *["mark"] * marked)


def _met(classes: DataFrame) -> DataFrame:
    """c, keys: the classes that share one of their rare n-grams with another class, and those n-grams alone."""
    rows = classes.select("c", F.explode("keys").alias("gram"))
    salted = rows.withColumn("salt", _salt("c"))
    parts = salted.groupBy("gram", "salt").agg(F.count("*").alias("m"))
    many = parts.groupBy("gram").agg(F.sum("m").alias("m"), F.collect_list("salt").alias("salts")).where("m > 1").select("gram", F.explode("salts").alias("salt"))
    return written(salted.join(many, ["gram", "salt"]).groupBy("c").agg(F.collect_list("gram").alias("keys")), "jaccard-met")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group, one for each group; documents without words stay."""
    found = _rooted(docs, n, percent, id_col, text_col, marked=True)
    key = row_key(F.col("doc_id"), F.col("mark"))
    first = found.where("n_shingles > 0 AND component_id <=> doc_id").groupBy("root").agg(F.min(key).alias("_key")).select("_key", F.lit(True).alias("_once"))
    wordless = found.where("n_shingles = 0").select(key.alias("_key"), F.lit(False).alias("_once")).distinct()
    return rows_of(docs, row_key(docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))), first.unionAll(wordless))
