"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch of texts lie in one symbol array. An index maps each pair's rank
to all its positions in that array. Active ranks are applied in ascending order; each merge updates
the lists of the pairs that it makes with its neighbours. Results of pre-tokens are kept per worker, up to a bound.

Null and empty texts give no ids and an empty text. Rows are independent, so repeated rows, ties and
an empty table need no special care; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tracequill.llm.common import ship

#: The white space of the tokenizer's pattern, and the pattern itself.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces within which the pattern always works alone: a run without white space, with one space before it, or white space.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A word of Latin letters and the ASCII marks after it: two pre-tokens, found without the general pattern.
LATIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
#: Pre-tokens and pieces that a worker remembers.
KEEP = 900_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str, keep: int = KEEP):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: i for i, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.parts: list[tuple[int, int]] = []
        born: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, new = vocab[a], vocab[b], vocab[a + b]
            if max(born.get(x, -1), born.get(y, -1)) >= r or new in born:
                raise ValueError("merges must build on earlier merges only, each token made once")
            born[new] = r
            self.rank[x << 32 | y] = r
            self.made.append(new)
            self.parts.append((x, y))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        start = ends - lengths
        raw = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(raw)
        if not n:
            return [b""] * len(words)
        inner = np.ones(n, bool)
        inner[ends[lengths > 0] - 1] = False
        at = np.flatnonzero(inner)
        pairs, which = np.unique(raw[at] << 32 | raw[at + 1], return_inverse=True)
        ranks = np.array([self.rank.get(p, -1) for p in pairs.tolist()], np.int64)[which] if len(at) else np.zeros(0, np.int64)
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        index: dict[int, list[int]] = {int(ranks[c]): x.tolist() for c, x in zip(cuts, np.split(at, cuts[1:]), strict=True)} if len(at) else {}
        active = sorted(index)
        sym = raw.tolist()
        after = np.where(inner, np.arange(1, n + 1), -1).tolist()
        first = np.zeros(n, bool)
        first[start[lengths > 0]] = True
        before = np.where(first, -1, np.arange(-1, n - 1)).tolist()
        rank, made, parts = self.rank, self.made, self.parts
        while active:
            r = heapq.heappop(active)
            (a, b), new = parts[r], made[r]
            for p in sorted(index.pop(r)):
                if sym[p] != a or (q := after[p]) < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                after[p] = z = after[q]
                if z >= 0:
                    before[z] = p
                    got = rank.get(new << 32 | sym[z])
                    if got is not None:
                        if got in index:
                            index[got].append(p)
                        else:
                            index[got] = [p]
                            heapq.heappush(active, got)
                if (y := before[p]) >= 0:
                    got = rank.get(sym[y] << 32 | new)
                    if got is not None:
                        if got in index:
                            index[got].append(y)
                        else:
                            index[got] = [y]
                            heapq.heappush(active, got)
        final = np.array(sym, np.int64)
        live = final >= 0
        count = np.concatenate([[0], np.cumsum(live)])
        data = final[live].astype("<u4").tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(count[start].tolist(), count[ends].tolist(), strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into the memory."""
        if len(self.pieces) + len(pieces) > self.keep:
            self.pieces.clear()
        cut = {p: (m.groups() if m[2] else (p,)) if (m := LATIN.fullmatch(p)) else PRETOKENS.findall(p) for p in pieces}
        new = list({w for ws in cut.values() for w in ws} - self.known.keys())
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = list({w for ws in cut.values() for w in ws})
        self.known.update(zip(new, self.merge_all([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        for p, ws in cut.items():
            self.pieces[p] = b"".join([self.known[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = [self.split.split(t) if self.split and "<|" in t else [t] for t in texts]
        cut = [[PIECES.findall(x) if i % 2 == 0 else [x] for i, x in enumerate(p)] for p in parts]
        out, todo = [], []
        get = self.pieces.get
        for p in cut:
            todo.append([list(map(get, x)) for x in p])
        new = set()
        for p, got in zip(cut, todo, strict=True):
            for i, (x, g) in enumerate(zip(p, got, strict=True)):
                if i % 2 == 0 and None in g:
                    new.update(w for w, y in zip(x, g, strict=True) if y is None)
        if new:
            self._learn(new)
            get = self.pieces.get
        for p, got in zip(cut, todo, strict=True):
            ids = []
            for i, (x, g) in enumerate(zip(p, got, strict=True)):
                if i % 2:
                    ids.append(np.array([self.special[x[0]]], "<u4").tobytes())
                else:
                    ids.append(b"".join([get(w) if y is None else y for w, y in zip(x, g, strict=True)] if None in g else g))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBPE] = {}


def loaded(path: str) -> PairIndexBPE:
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch, most: int = 4_000_000, column: int = 1):
    """Slices of a batch whose texts hold about so many bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += s
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string): no shuffle; each task works batch by batch."""
    ship(docs.sparkSession)

    def run(batches):
        coder = loaded(vocabulary)
        for b in batches:
            for part in slices(b):
                ids = coder.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, by the same encoder and decoder; ids and texts stay in the task."""
    ship(docs.sparkSession)

    def run(batches):
        coder = loaded(vocabulary)
        for b in batches:
            for part in slices(b):
                ids = coder.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
