"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file holds blocks of a fixed number of ids, then an index and a footer. Each block starts from the
same fresh model. For each id the model has predictions of three orders: the id that followed the last
two ids, the one that followed the last id, and an order-0 table. The higher order with any
confidence names a candidate; both orders' counters are mixed (integer logistic mixing, learnt weights) to the probability that
it is right, and a range coder codes that decision. A wrong candidate is followed by the id itself: its
high part is coded by the adaptive order-0 table, its low part, which is spread evenly, is stored as it is.

Blocks are independent, so numpy works on many blocks in step, one per lane. All arithmetic is on
integers, or divides and multiplies doubles as IEEE 754 fixes it: every machine decodes what another wrote.

Null or empty texts hold the end id alone. Repeated rows keep their own entries. An empty table gives
no files. Rows whose doc_id is null come first, as Spark sorts them.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequill.llm import words
from tracequill.llm.bpe import slices
from tracequill.llm.common import new_folder, open_fs, ship, tidy, written

MAGIC = b"TQIDS006"
#: Bytes of texts that a writer encodes together, and words that its worker remembers: nearly all others are met once.
SLICE, KEEP = 16_000_000, 1_000_000
#: Ids in a block, and the most blocks that are worked on in step: with more of them the tables leave the cache.
BLOCK, LANES = 2048, 2048
#: Slots of the order-1 and order-2 tables of a block (as powers of two), and how often the order-0 table is renewed.
ONE_BITS, TWO_BITS, REFRESH = 8, 8, 256
#: Bits of the range coder's words; a range has two of them.
WORD = 24
LOW = (1 << WORD) - 1
_STRETCH = np.round(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256).astype(np.int32)
_SQUASH = np.clip(np.searchsorted(_STRETCH, np.arange(-2048, 2048)), 32, 4064).astype(np.int32)
#: What is added to a slot (eight times its id, and its confidence from 0 to 7), by confidence after a right guess, then after a wrong one; _NEW: it takes the id that came.
_NEW = -8
_GAIN = np.array([1, 1, 1, 1, 1, 1, 1, 0, _NEW, _NEW, -1, -2, -2, -3, -3, -4], np.int32)


class Model:
    """The state of all lanes; encoder and decoder drive it alike. Arrays of shape (2, lanes) hold order 1 and order 2. Ids come eightfold, as slots hold them.

    Counters and frequencies lie lane by lane for each state and symbol: lanes are mostly in the same few of them, so neighbours share lines of the cache.
    """

    def __init__(self, lanes: int, vocab: int):
        self.n = lanes
        self.low_bits = max(8, max(1, vocab - 1).bit_length() - 8)
        self.symbols = (max(1, vocab) - 1 >> self.low_bits) + 1
        self.base = np.stack([np.arange(lanes) << ONE_BITS, (lanes << ONE_BITS) + (np.arange(lanes) << TWO_BITS)])
        self.slots = np.zeros(lanes * ((1 << ONE_BITS) + (1 << TWO_BITS)), np.int32)  # id and confidence of each context
        self.cells = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes)
        self.prob = np.full(2 * lanes * 16, 1 << 15, np.int32)
        self.weight = np.full((2, lanes), 1 << 15, np.int32)
        self.count = np.zeros((self.symbols, lanes), np.int32)
        self.lane = np.arange(lanes)
        self.refresh()

    def places(self, last1: np.ndarray, last2: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Slots of the last id and of the last two, both unsigned, in at: steps by lanes, or one step's lanes."""
        one = last1 * np.uint32(0x9E3779B1)
        np.add(one >> 32 - ONE_BITS, self.base[0], out=at[..., 0, :])
        one += last2 * np.uint32(0x85EBCA77)
        one >>= 32 - TWO_BITS
        np.add(one, self.base[1], out=at[..., 1, :])
        return at

    def refresh(self, seen: np.ndarray | None = None) -> None:
        """Frequencies of the high parts, 4096 together, each at least 1. seen: the cells that were coded since the last time."""
        count = self.count
        if seen is not None:
            count += (np.bincount(seen, minlength=count.size) << 5).reshape(count.shape)
        freq = (count * ((4096 - self.symbols) / np.maximum(count.sum(axis=0), 1))).astype(np.int32)
        freq += 1
        freq[count.argmax(axis=0), self.lane] += 4096 - freq.sum(axis=0, dtype=np.int32)
        self.freq = freq
        start = np.zeros_like(freq)
        for i in range(1, self.symbols):
            np.add(start[i - 1], freq[i - 1], out=start[i])
        start <<= 13
        start += freq
        self.span = start.ravel()  # where a symbol's range begins and how wide it is
        np.minimum(np.maximum(self.weight, -(1 << 17), out=self.weight), 1 << 17, out=self.weight)  # sums stay within 32 bits until the next time

    def guess(self, at: np.ndarray) -> np.ndarray:
        """The probability, of 4096, that the candidate for the slots at is right."""
        self.at = at
        self.slot = slot = self.slots.take(at, mode="clip")
        self.sure = slot & 7
        self.cell = cell = self.sure + (np.minimum(slot[0] ^ slot[1], 8) & 8)  # the state: also whether both orders name one id
        cell *= 2 * self.n
        cell += self.cells
        self.old = self.prob.take(cell, mode="clip")
        self.part = self.old >> 4
        self.stretch = _STRETCH.take(self.part)
        dot = self.weight * self.stretch
        dot = dot[0] + dot[1]
        dot >>= 16
        dot += 2048
        self.p = _SQUASH.take(dot, mode="clip")
        return self.p

    def candidate(self) -> np.ndarray:
        return np.where(self.sure[1] > 0, self.slot[1], self.slot[0]) & -8

    def learn(self, ids: np.ndarray, right: np.ndarray) -> None:
        one = right.astype(np.int32)
        goal = one << 12
        self.stretch *= goal - self.p
        self.stretch >>= 12
        self.weight += self.stretch
        self.old -= self.part
        self.old += goal - one
        self.prob[self.cell] = self.old
        which = np.minimum(self.slot ^ ids, 8)
        which &= 8
        which += self.sure
        gain = _GAIN.take(which)
        self.slot += gain
        self.slots[self.at] = np.where(gain > _NEW, self.slot, ids + 1)


def turned(a: np.ndarray) -> np.ndarray:
    """The transpose, copied in strips: whole columns at once would share few lines of the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, len(a), 64):
        out[:, i : i + 64] = a[i : i + 64].T
    return out


def encode_blocks(ids: np.ndarray, vocab: int) -> list[bytes]:
    """ids: one block per row. The bytes of each: the range coder's words, then the low parts of the ids that were not guessed."""
    lanes, steps = ids.shape
    m = Model(lanes, vocab)
    room = steps + 8  # a step takes 19 bits at most
    out, begins = np.zeros(lanes * room, np.int32), np.arange(lanes) * room
    pos = begins.copy()
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << 2 * WORD, np.int64)
    columns = np.zeros((steps + 2, lanes), np.uint32)
    columns[2:] = turned(ids)
    missed = np.zeros((steps, lanes), bool)
    for begin in range(0, steps, REFRESH):
        end = min(steps, begin + REFRESH)
        at = m.places(columns[begin + 1 : end + 1], columns[begin:end], np.empty((end - begin, 2, lanes), np.int64))
        now = (columns[begin + 2 : end + 2] << 3).view(np.int32)
        high = (columns[begin + 2 : end + 2] >> m.low_bits) * np.int64(lanes) + m.lane
        span = m.span.take(high)  # of the high part, coded where the guess is wrong
        start, freq = span >> 13, span & 8191
        for t in range(end - begin):
            p = m.guess(at[t])
            right = m.candidate() == now[t]
            np.logical_not(right, out=missed[begin + t])
            bound = (width >> 12) * p
            r = width - bound >> 12
            low += np.where(right, 0, bound + r * start[t])
            width = np.where(right, bound, r * freq[t])
            full = width <= LOW
            out[pos] = low >> WORD  # the bit above the word is a carry for the one before; stays if the word is full
            pos += full
            low = np.where(full, (low & LOW) << WORD, low)
            width = np.where(full, width << WORD, width)
            m.learn(now[t], right)
        if end < steps:
            m.refresh(high[missed[begin:end]])
    for _ in range(2):
        out[pos] = low >> WORD
        pos += 1
        low = (low & LOW) << WORD
    while len(big := np.flatnonzero(out > LOW)):
        out[big] -= 1 << WORD
        out[big - 1] += 1
    missed = turned(missed)
    parts = (ids[missed] & (1 << m.low_bits) - 1).astype("<u1" if m.low_bits == 8 else "<u4")
    ends = np.cumsum(missed.sum(axis=1)).tolist()
    words = out.astype("<u4", copy=False).view(np.uint8).reshape(lanes, room, 4)[:, :, : WORD // 8]
    return [struct.pack("<I", n) + words[i, :n].tobytes() + parts[a:b].tobytes() for i, (n, a, b) in enumerate(zip((pos - begins).tolist(), [0, *ends], ends, strict=False))]


def decode_blocks(blocks: list[bytes], steps: int, vocab: int) -> np.ndarray:
    lanes = len(blocks)
    m = Model(lanes, vocab)
    kind = np.dtype("<u1" if m.low_bits == 8 else "<u4")
    coded, parts, pos, at_part = [], [], [], []
    n = k = 0
    for b in blocks:
        size = struct.unpack_from("<I", b)[0]
        pos.append(n)
        at_part.append(k)
        coded.append(np.frombuffer(b, np.uint8, size * WORD // 8, 4).reshape(-1, WORD // 8))
        parts.append(np.frombuffer(b, kind, offset=4 + size * WORD // 8))
        n += size
        k += len(parts[-1])
    coded = np.concatenate([*coded, np.zeros((4 + steps, WORD // 8), np.uint8)])
    coded = coded[:, 0] | coded[:, 1].astype(np.int32) << 8 | coded[:, 2].astype(np.int32) << 16
    parts = np.concatenate([*parts, np.zeros(1, kind)])
    pos, at_part = np.array(pos), np.array(at_part)
    code = coded[pos].astype(np.int64) << WORD | coded[pos + 1]
    pos += 2
    width = np.full(lanes, 1 << 2 * WORD, np.int64)
    result = np.zeros((steps + 2, lanes), np.uint32)
    lane = np.arange(lanes) << 12
    names = np.tile(np.arange(m.symbols, dtype=np.uint8 if m.symbols <= 256 else np.int16), lanes)
    seen, hit = np.empty((REFRESH, lanes), np.int64), np.empty((REFRESH, lanes), bool)
    at = np.empty((2, lanes), np.int64)
    for t in range(steps):
        if t % REFRESH == 0:
            if t:
                m.refresh(seen[~hit])
            which = np.repeat(names, m.freq.T.ravel())  # the symbol of each of a lane's 4096 places
        p = m.guess(m.places(result[t + 1], result[t], at))
        bound = (width >> 12) * p
        right = np.less(code, bound, out=hit[t % REFRESH])
        r = width - bound >> 12
        rest = code - bound
        place = (rest / r).astype(np.int64)  # exact: quotients under 2**12 by numbers under 2**36; of no use where the guess is right
        place += lane
        high = which.take(place, mode="clip").astype(np.int64)
        h = np.add(high * lanes, m.lane, out=seen[t % REFRESH])
        span = m.span.take(h, mode="clip")
        code = np.where(right, code, rest - r * (span >> 13))
        width = np.where(right, bound, r * (span & 8191))
        now = np.where(right, m.candidate(), ((high << m.low_bits) + parts.take(at_part, mode="clip") << 3).astype(np.int32))
        at_part += ~right
        full = width <= LOW
        code = np.where(full, code << WORD | coded.take(pos, mode="clip"), code)
        width = np.where(full, width << WORD, width)
        pos += full
        np.right_shift(now, 3, out=result[t + 2].view(np.int32))
        m.learn(now, right)
    return turned(result[2:])


class Writer:
    """One file: blocks as they fill up, then the index and the footer."""

    def __init__(self, sink, vocab: int, block: int = BLOCK, lanes: int = LANES):
        self.sink, self.vocab, self.block, self.lanes = sink, vocab, block, lanes
        self.held: list[np.ndarray] = []
        self.waiting = self.at = 0
        self.blocks: list[tuple] = []
        self.docs: list[tuple] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, begin: np.ndarray) -> None:
        """Documents whose ids lie one after another, each from its place in begin, which holds the end of the last too."""
        self.docs += zip(doc_ids, np.diff(begin).tolist(), strict=True)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block * self.lanes:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        full = len(ids) // self.block
        if not last:
            full -= full % self.lanes  # few lanes cost a step as much as many
        for begin in range(0, full * self.block, self.block * self.lanes):
            self._write(ids[begin : min(full * self.block, begin + self.block * self.lanes)].reshape(-1, self.block))
        ids = ids[full * self.block :]
        if last and len(ids):
            self._write(np.ascontiguousarray(ids).reshape(1, -1))
            ids = ids[:0]
        self.held, self.waiting = [ids], len(ids)

    def _write(self, ids: np.ndarray) -> None:
        for row, data in zip(ids, encode_blocks(ids, self.vocab), strict=True):
            self.blocks.append((self.at, len(data), len(row), zlib.crc32(row.astype("<u4").tobytes())))
            self.put(data)

    def close(self) -> int:
        self.flush(last=True)
        index = zlib.compress(json.dumps({"vocab": self.vocab, "blocks": self.blocks, "docs": self.docs}).encode(), 1)
        self.put(index)
        self.put(struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
        return sum(b[2] for b in self.blocks)


def read_file(source, lanes: int = LANES):
    """(doc_id, ids) in order, from a file opened for random reads; checks all sums."""
    source.seek(source.size() - 20)
    tail = source.read(20)
    size, sum_ = struct.unpack("<QI", tail[:12])
    if tail[12:] != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(source.size() - 20 - size)
    raw = source.read(size)
    if zlib.crc32(raw) != sum_:
        raise ValueError("damaged index")
    index = json.loads(zlib.decompress(raw))
    docs, blocks = iter(index["docs"]), index["blocks"]
    held, i = np.zeros(0, "<u4"), 0
    doc = next(docs, None)
    while i < len(blocks):
        j = i
        while j < len(blocks) and j - i < lanes and blocks[j][2] == blocks[i][2]:
            j += 1
        data = []
        for at, n, _, _ in blocks[i:j]:
            source.seek(at)
            data.append(source.read(n))
        try:
            rows = decode_blocks(data, blocks[i][2], index["vocab"]).astype("<u4")
        except (IndexError, ValueError, struct.error) as x:  # what damaged bytes lead a decoder to
            raise ValueError(f"damaged block among those from {blocks[i][0]}") from x
        for row, b in zip(rows, blocks[i:j], strict=True):
            if zlib.crc32(row.tobytes()) != b[3]:
                raise ValueError(f"damaged block at {b[0]}")
        held, i = np.concatenate([held, rows.ravel()]), j
        used = 0
        while doc is not None and used + doc[1] <= len(held):
            yield doc[0], held[used : used + doc[1]]
            used += doc[1]
            doc = next(docs, None)
        held = held[used:]
    if doc is not None or len(held):
        raise ValueError("the index and the blocks differ")


def write_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one file per range of doc_id and returns the manifest (part, path, n_docs, n_ids, start): one row per file, written as a table."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "ids")

    def run(batches):
        coder = words.loaded(vocabulary, KEEP)
        part = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        name, made, out, n = f"{base}/part-{part:06d}.ids", f"{base}/.writing-{uuid.uuid4().hex}", None, 0
        sink = None
        for b in batches:
            for s in slices(b, SLICE):
                if out is None:
                    sink = fs.open_output_stream(made)
                    out = Writer(sink, len(coder.ends))
                out.add(s.column(0).to_pylist(), *coder.encode(s.column(1), end_id))
                n += s.num_rows
        if out is not None:
            total = out.close()
            sink.close()
            fs.move(made, name)  # a task that runs again writes the same bytes
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/part-{part:06d}.ids"]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text")))
    manifest = written(rows.mapInArrow(tidy(run), "part long, path string, n_docs long, n_ids long"), "ids-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = open_fs(path)
                rows: list[tuple] = []
                with fs.open_input_file(name) as f:
                    for doc, ids in read_file(f):
                        raw = ids.tobytes()
                        rows.append((doc, start, len(ids), zlib.crc32(raw), *[raw] * with_ids))
                        start += len(ids)
                        if len(rows) >= 2000:
                            yield _batch(rows, with_ids)
                            rows = []
                if rows:
                    yield _batch(rows, with_ids)

    files = manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(tidy(run), schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
