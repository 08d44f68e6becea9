"""Whole texts to ids with the tokenizers library, piece by piece.

Texts are cut at ASCII white space, where the word-level vocabularies never join anything, and before the marks that end a piece; Arrow finds the distinct
words of a batch, the library encodes each new one once, and a worker remembers them in a few arrays, up to a bound. The result
equals one call of the library on the whole text (tested against it). Vocabularies for which
this would not hold are refused by check().
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tracequill.llm.bpe import byte_letters

#: Words that a worker remembers (at least those of its last batch), words that the library is given at once, and bytes of texts that are encoded together.
KEEP, GIVEN, SLICE = 500_000, 10_000, 4_000_000
#: ASCII marks: where a piece ends in some of them after an ASCII letter, and the first is no apostrophe, the two sides never share a token.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of Latin-1 only, or marks of ASCII only: one pre-token, hence one end-of-word id.
PLAIN = r"\A(?:[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+|[!-&(-/:-@\[-`{-~]+)\z"


class WordCoder:
    def __init__(self, path: str, keep: int = KEEP):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        self.tok = Tokenizer.from_file(path)
        self.alone = Tokenizer(self.tok.model)
        self.alone.pre_tokenizer = CharDelimiterSplit(" ")
        self.tok.no_padding()
        self.tok.no_truncation()
        mark = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for word, i in spec["model"]["vocab"].items():
            self.ends[i] = word.endswith(mark)
        self.sep = spec["added_tokens"][0]["content"]
        self.sep_id = spec["added_tokens"][0]["id"]
        self.keep = keep
        self.letters = {i: c for i, c in enumerate(byte_letters()) if c != chr(i) and i != 32}
        self.known = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @staticmethod
    def check(spec: dict) -> None:
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or not spec["model"].get("end_of_word_suffix") or spec["post_processor"]:
            raise ValueError("only lower-casing vocabularies with ends of words can be encoded piece by piece")
        if any(re.search(r"\s", t["content"]) or not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("added tokens must be free of white space and begin with <|")

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each one's begin and how many they are."""
        old, ids, start, length = self.known
        place = pc.index_in(old, words)  # the table is made of the few, not of all that is remembered
        met = place.is_valid().to_numpy(zero_copy_only=False)
        where = np.full(len(words), -1)
        where[place.drop_null().to_numpy()] = np.flatnonzero(met)
        new = where < 0
        fresh = words.filter(pa.array(new))
        more, begin, size = self._encoded(fresh)
        where[new] = np.arange(len(old), len(old) + len(fresh))
        start, length, ids = np.concatenate([start, begin + len(ids)]).astype(np.int32), np.concatenate([length, size]), np.concatenate([ids, more])
        if len(old) + len(fresh) <= self.keep:
            self.known = pa.concat_arrays([old, fresh]), ids, start, length
            return ids, start.take(where), length.take(where)
        ids, ends = gathered(ids, start, length, where)
        self.known = words, ids, ends[:-1].astype(np.int32), length.take(where)
        return self.known[1:]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the library."""
        start, length, done, n = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), [], 0

        def put(which: np.ndarray, ids: np.ndarray, after: np.ndarray) -> bool:
            """after: where each word's ids end. False if there is not one end for each word."""
            nonlocal n
            if len(after) != len(which):
                return False
            length[which] = np.diff(after, prepend=0)
            start[which] = n + after - length[which]
            done.append(ids)
            n += len(ids)
            return True

        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain & (pc.binary_length(words).to_numpy() > 0))
        other = [rest[i : i + GIVEN] for i in range(0, len(rest), GIVEN)]
        ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        for which in [x[i : i + GIVEN] for x in (np.flatnonzero(plain & ascii_), np.flatnonzero(plain & ~ascii_)) for i in range(0, len(x), GIVEN)]:  # one pre-token each once in lower case, so the library's model alone
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(which)], pa.int32()), words.take(pa.array(which))), " ")[0].as_py()
            if not text.isascii():
                text = text.lower().encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.alone.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            if not put(which, ids, np.flatnonzero(self.ends[ids]) + 1):
                other.append(which)
        for which in other:
            ids = self._library("".join(w + self.sep for w in words.take(pa.array(which, pa.int64())).to_pylist()))
            keep = ids != self.sep_id
            if not put(which, ids[keep], np.cumsum(keep)[~keep]):
                raise ValueError("an added token within a piece")
        return np.concatenate([*done, np.zeros(0, "<u4")]), start, length

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of distinct pieces: each is a word and the marks that end it, if they can be told apart."""
        offsets, raw = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1], np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        size = pc.binary_length(pc.ascii_rtrim(pieces, MARKS)).to_numpy()
        middle = offsets[:-1] + size
        cut = (size > 0) & (middle < offsets[1:])
        at = middle[cut]
        cut[cut] = (raw[at - 1] >= 97) & (raw[at - 1] <= 122) & (raw[at] != 39)
        both = np.empty(2 * len(pieces) + 1, np.int32)  # each piece's word and then its marks, or nothing
        both[::2], both[1::2] = offsets, np.where(cut, middle, offsets[1:])
        words = pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(both), pieces.buffers()[2]).dictionary_encode()
        ids, start, length = self._ids_of(words.dictionary)
        ids, ends = gathered(ids, start, length, words.indices.to_numpy())
        begin = ends[::2]
        return ids, begin[:-1].astype(np.int32), np.diff(begin).astype(np.int32)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, one after another, and where each text's begin (with the end of the last)."""
        ids, begin = self._encode(texts)
        begin = begin + np.arange(len(begin))
        out = np.full(begin[-1], end_id, "<u4")
        own = np.ones(len(out), bool)
        own[begin[1:] - 1] = False
        out[own] = ids
        return out, begin

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        added = pc.match_substring(texts, "<|")
        whole = np.flatnonzero(added.to_numpy(zero_copy_only=False)).tolist()  # may hold an added token: encoded in one piece
        plain = pc.if_else(added, "", texts) if whole else texts
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = pieces.flatten().dictionary_encode()
        out, ends = gathered(*self._pieces(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        offsets = pieces.offsets.to_numpy()
        begin = ends[offsets - offsets[0]]
        if not whole:
            return out, begin
        rows = [out[i:j] for i, j in itertools.pairwise(begin.tolist())]
        for i in whole:
            rows[i] = self._library(texts[i].as_py())
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries which, one after another, and where each entry's begin (with the end of the last)."""
    count = length.take(which)
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(count, out=ends[1:])
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids at once")
    at = np.repeat(start.take(which) - ends[:-1].astype(np.int32), count)
    at += np.arange(len(at), dtype=np.int32)
    return ids.take(at), ends


_loaded: dict[tuple[str, int], WordCoder] = {}


def loaded(path: str, keep: int = KEEP) -> WordCoder:
    """This worker's coder of a vocabulary."""
    if (path, keep) not in _loaded:
        _loaded[path, keep] = WordCoder(path, keep)
    return _loaded[path, keep]
