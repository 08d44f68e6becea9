"""Many words in one pass over a text: an Aho-Corasick automaton for each list, built once a worker and run over Arrow batches."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_built: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def built(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """This worker's automaton of a list; its values are the words' places in the list."""
    if words not in _built:
        a = ahocorasick.Automaton()
        for i, w in enumerate(words):
            a.add_word(w, i)
        a.make_automaton()
        _built[words] = a
    return _built[words]


def places(text: str, a: ahocorasick.Automaton) -> list[int]:
    """Sorted places of the words that a text holds, each once."""
    return sorted({i for _, i in a.iter(text)})


def found(text: Column, words: tuple[str, ...]) -> Column:
    """The places in a list (from 0, sorted) of the words that a text holds; empty for null. Case counts."""
    words = tuple(dict.fromkeys(words))

    def run(texts: pa.Array) -> pa.Array:
        a = built(words)
        return pa.array([places(t, a) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def counted(text: Column, words: tuple[str, ...]) -> Column:
    """How many words of a list a text holds; each counts once, null holds none."""
    words = tuple(dict.fromkeys(words))

    def run(texts: pa.Array) -> pa.Array:
        a = built(words)
        return pa.array([len({i for _, i in a.iter(t)}) if t else 0 for t in texts.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(text)
