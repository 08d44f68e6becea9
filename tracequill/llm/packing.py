"""Packing token sequences by minimum bin slack.

Each document is tokenized whole, ended with an end id and cut into full windows; what remains of it
is one piece. A task keeps a pool of such pieces, counted by length. To fill a window it takes the
longest piece and asks a bitset subset-sum program for the multiset of other lengths whose sum comes
closest to the room left; layers of the bitset give the counts back. A multiset with no slack is used as often as the
pool allows. Windows with slack wait for more pieces. When a pool is full of such pieces, or at the end of a partition, the program's closest multisets
are taken all the same, and their slack is filled with the head of one more piece, whose tail stays in the pool; what is less than a window at the very end
is cut to powers of two, so no sequence is padded.

Null or empty texts give the end id alone. Repeated rows and ties are packed like any others; an
empty table gives no rows. Sequence ids are unique across partitions and depend on the partition's rows only, so a
task that is run again gives the same rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracequill.llm import words
from tracequill.llm.bpe import slices
from tracequill.llm.common import ship, tidy

#: Pieces in a task's pool before windows without slack are taken from it.
POOL = 4096
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to room of a multiset within counts, and how often it takes each length."""
    reach, full, layers = 1, (1 << room + 1) - 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            layers.append((reach, size, take))
            reach |= reach << size * take & full
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for before, size, take in reversed(layers):
        if not before >> at & 1:
            at -= size * take
            used[size] += take
    return best, dict(used)


class Pool:
    """Pieces (doc_id, start, doc_tokens, ids) by length, and the windows made from them."""

    def __init__(self, window: int):
        self.window, self.held, self.n = window, defaultdict(list), 0

    def add(self, piece: tuple) -> None:
        self.held[len(piece[3])].append(piece)
        self.n += 1

    def _take(self, size: int) -> tuple:
        got = self.held[size].pop()
        if not self.held[size]:
            del self.held[size]
        self.n -= 1
        return got

    def exact(self):
        """Windows without slack, until the longest pieces find none."""
        waiting: dict[int, list] = {}
        while self.held:
            top = max(self.held)
            counts = {s: len(x) for s, x in self.held.items()}
            counts[top] -= 1
            best, used = closest({s: c for s, c in counts.items() if c}, self.window - top)
            if best < self.window - top:
                waiting[top] = self.held.pop(top)
                continue
            used[top] = used.get(top, 0) + 1
            for _ in range(min(len(self.held[s]) // c for s, c in used.items())):
                yield [self._take(s) for s in sorted(used, reverse=True) for _ in range(used[s])]
        self.held.update(waiting)

    def rest(self):
        """All that is left: for the longest piece the multiset of least slack, and a cut for that slack; in the end, powers of two."""
        total = sum(size * len(x) for size, x in self.held.items())
        while total >= self.window:
            window = [self._take(max(self.held))]
            room = self.window - len(window[0][3])
            best, used = closest({s: len(x) for s, x in self.held.items()}, room)
            window += [self._take(s) for s in sorted(used, reverse=True) for _ in range(used[s])]
            if best < room:  # each piece that is left is longer than the slack, or the program would have taken it
                window.append(self._head(room - best))
            total -= self.window
            yield window
        while self.held:
            room, part = 1 << total.bit_length() - 1, []
            total -= room
            while room:
                size = max(self.held)
                part.append(self._take(size) if size <= room else self._head(room))
                room -= len(part[-1][3])
            yield part

    def _head(self, size: int) -> tuple:
        """The first ids of the longest piece; the others stay in the pool."""
        doc, start, n, ids = self._take(max(self.held))
        self.add((doc, start + size, n, ids[size:]))
        return doc, start, n, ids[:size]


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit). No shuffle."""
    ship(docs.sparkSession)
    if window & window - 1:
        raise ValueError("the window must be a power of two")

    def run(batches):
        coder, held = words.loaded(vocabulary), Pool(window)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        size = 0

        def put(sequence):
            nonlocal number, size
            offset = 0
            for doc, start, n, ids in sequence:
                rows.append((doc, start, len(ids), n, number, offset, ids.tobytes()))
                offset += len(ids)
            size += offset
            number += 1

        def out():
            nonlocal size
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)]
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            for part in slices(b, words.SLICE):
                whole, begin = coder.encode(part.column(1), end_id)
                for doc, i, j in zip(part.column(0).to_pylist(), begin.tolist(), begin[1:].tolist()):
                    ids, n = whole[i:j], j - i
                    for at in range(0, n - window + 1, window):
                        put([(doc, at, n, ids[at : at + window])])
                    if n % window:
                        held.add((doc, n - n % window, n, ids[n - n % window :].copy()))
                    if held.n >= pool:
                        for x in held.exact():
                            put(x)
                        if held.n >= pool // 2:
                            for x in held.rest():
                                put(x)
                    if size >= 1 << 20:
                        yield out()
        for x in held.exact():
            put(x)
        for x in held.rest():
            put(x)
        if rows:
            yield out()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)
