"""Language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text is kept as a suffix automaton, which knows all its substrings. A text is parsed against it: the longest
match with any place of the sample is a phrase, the next phrase begins where that match ends, and a letter that the sample lacks is a phrase of its own. A language
like the text needs few, long phrases; phrases times log2(size of the sample) over the text's bytes estimates the cross entropy, and the language with the least one wins.

Texts are compared in lower case as UTF-8 bytes, all that stands between ASCII letters and bytes of other characters made one space. They are read in blocks of BLOCK bytes, at whose ends
phrases end, so that very long texts are parsed like many short ones: all blocks of a batch go through an automaton in step, one byte at a time, by a dense table
of moves whose entries also tell whether a phrase ended there.

Samples: of each language the PASSAGES rows with the smallest hashes of their id and text, and of each of those a passage of WIDTH characters at a place drawn by the
hash; fewer of each if there are so many languages that all samples together would pass TOTAL characters. That bound is the only thing the model reads less of; every text is predicted whole.

Null texts and texts without a letter are `und` with score 0, and so are all where nothing was learnt. With a single language learnt the score is 1. Ties go to the smaller name. Null
labels and null texts teach nothing. Other columns stay, except those of the two results' names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracequill.llm.common import ship

#: Passages of a language and characters of each, characters of all samples together, and bytes of a block.
PASSAGES, WIDTH, TOTAL, BLOCK = 64, 500, 4_000_000, 256
#: Blocks that are parsed in step, and bytes of text that are prepared together.
LANES, SLICE = 16_384, 4_000_000
#: A byte that no UTF-8 text holds: keeps the passages of a sample apart.
APART = 0xFF
_SPACED = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _SPACED[_c] = _c if chr(_c).isalpha() and chr(_c).islower() else 0x20


def prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are parsed, of all texts, and where each text's begin (with the end of the last)."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = _SPACED[np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    space = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = offsets[:-1][offsets[:-1] < len(data)]
    keep[at] = True
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return data[keep], ends[offsets]


class Automaton:
    """The suffix automaton of a sample as a table of moves: from each state by each class of bytes, four times the place of the next state's row, plus how many phrases end: the open one, and that of a byte which the sample lacks."""

    def __init__(self, sample: bytes, classes: np.ndarray, width: int):
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in sample:
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] != length[p] + 1:
                    twin = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = twin
                    q = twin
                link[now] = q
            last = now
        root = np.zeros(width, np.int64)
        for c, s in nexts[0].items():
            root[classes[c]] = s
        # where a match can't go on, the phrase ends and the byte begins the next one
        table = np.tile(root * width * 4 + 1 + (root == 0), (len(nexts), 1))
        states = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
        table[states, classes[np.fromiter((c for x in nexts for c in x), np.int64, len(states))]] = np.fromiter((s for x in nexts for s in x.values()), np.int64, len(states)) * width * 4
        table[0] = root * width * 4 + (root == 0)  # at the start no phrase is open
        table[:, 0] = np.arange(len(nexts)) * width * 4  # class 0 fills up blocks and moves nothing
        self.moves = table.ravel().astype(np.int32)
        self.size = max(2, len(sample))

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """How many phrases each column of classes needs."""
        state, count = np.zeros(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
        for classes in lanes:
            move = self.moves.take(state + classes)
            count += move & 3
            state = move >> 2
        return count + (state > 0)


@dataclass
class Languages:
    """Samples by language; fit() makes one."""

    samples: dict[str, bytes] = field(default_factory=dict)

    def predicted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with lang_pred and score (0 to 1: how much fewer normalised phrases the winner needs than the next)."""
        ship(docs.sparkSession)
        samples = self.samples
        kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
        # lettered texts alone go on as texts: the rest need no parsing
        said = F.when(F.regexp_like(docs[text_col].cast("string"), F.lit(r"\p{L}")), docs[text_col].cast("string"))
        rows = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c] for c in kept]).alias("row"), said.alias("said"))

        def run(batches):
            model = loaded(samples)
            for b in batches:
                names, scores = model.best(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

        schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "score")


class Parsers:
    """A worker's automata of all languages, over the same classes of bytes."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        used = sorted(set(b"".join(samples.values())) - {APART})
        # class 0 fills up, 1 is any byte that no sample holds
        self.classes = np.ones(256, np.int32)
        self.classes[used] = np.arange(2, len(used) + 2)
        self.apart = len(used) + 2
        learnt = self.classes.copy()
        learnt[APART] = self.apart
        self.automata = [Automaton(samples[n], learnt, self.apart + 1) for n in self.names]

    def best(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language and the score of each text; `und` and 0 for null."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        for first, count, sizes, phrases in self._parsed(texts):
            rate = phrases * np.array([math.log2(a.size) for a in self.automata])[:, None] / np.maximum(1, sizes)
            order = np.argsort(rate, axis=0, kind="stable")
            least = np.take_along_axis(rate, order, axis=0)
            score = np.ones(count) if len(self.names) == 1 else 1 - least[0] / np.maximum(least[1], 1e-12)
            for i in np.flatnonzero(texts[first : first + count].is_valid().to_numpy(zero_copy_only=False)).tolist():
                names[first + i], scores[first + i] = self.names[order[0, i]], float(min(1.0, max(0.0, score[i])))
        return names, scores

    def _parsed(self, texts: pa.Array):
        """Slices of the texts: the number of the first, how many, their bytes, and the phrases of each by language."""
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
            data, begins = prepared(texts[first:last])
            sizes = np.diff(begins)
            blocks = -(-sizes // BLOCK)
            owner = np.repeat(np.arange(last - first), blocks)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = begins[:-1][owner] + nth * BLOCK
            size = np.minimum(BLOCK, begins[1:][owner] - start)
            coded = np.append(self.classes[data], 0)
            total = np.zeros((len(self.names), last - first))
            order = np.argsort(-size, kind="stable")  # blocks of a size together: the last ones of texts don't run as long as full ones
            for i in range(0, len(order), LANES):
                some = order[i : i + LANES]
                step = np.arange(int(size[some].max()))[:, None]
                lanes = np.where(step < size[some], coded[np.minimum(start[some] + step, len(data))], 0).astype(np.int32)
                for k, a in enumerate(self.automata):
                    total[k] += np.bincount(owner[some], weights=a.phrases(lanes), minlength=last - first)
            yield first, last - first, sizes, total
            first = last


_loaded: dict[str, Parsers] = {}


def loaded(samples: dict[str, bytes]) -> Parsers:
    """This worker's automata; one model is kept."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Parsers(samples)
    return _loaded[key]


def held_out(doc_id: Column, of: int = 4, fold: int = 2) -> Column:
    """Whether an id lies in the fold that nothing is learnt from: crc32 of its digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == fold, F.lit(False))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", passages: int = PASSAGES, width: int = WIDTH, seed: int = 7) -> Languages:
    """Learns from the rows given, which the caller keeps free of held-out ones."""
    rows = docs.where(docs[lang_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), docs[id_col].alias("id"))
    rows = rows.where(F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("h", F.xxhash64("id", F.crc32(F.col("text").cast("binary")), F.lit(seed)))
    languages = rows.select("lang").distinct().count()
    most = max(1, min(passages, TOTAL // (width * max(1, languages))))
    at = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - width + 1)).cast("int") + 1
    rows = rows.select("lang", "h", F.substring(F.col("text"), at, F.lit(width)).alias("passage"))
    drawn = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "passage"))).where(F.col("n") <= most)  # cut in each partition before the shuffle
    samples: dict[str, list[str]] = {}
    for r in drawn.select("lang", "n", "passage").collect():  # at most TOTAL characters
        samples.setdefault(r["lang"], []).append(r["passage"])
    joined = {}
    for lang, parts in samples.items():
        data, begins = prepared(pa.array(sorted(parts)))
        joined[lang] = bytes([APART]).join(data[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True))
    return Languages(joined)
