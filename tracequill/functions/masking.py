"""Masking of personal data in payloads of any depth: recognisers with checks, overlaps resolved, the original's hash kept."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequill.functions.text_scans import PII

_PATTERNS = {name: re.compile(p) for name, p in PII.items()}
#: A character without which a type cannot stand in a text; all types but mail addresses need a digit too.
_NEEDS = {"EMAIL_ADDRESS": "@", "IP_ADDRESS": ".", "US_SSN": "-", "PHONE_NUMBER": "+"}
_DIGIT = re.compile("[0-9]")
_sorted_json, _compact_json = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode, json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def luhn(digits: str) -> bool:
    """Whether the digits of a card number, 13 or more, add up."""
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return len(d) >= 13 and sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an account number are right: letters as numbers, the first four characters last, 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


#: Types whose shape alone is not enough.
CHECKS = {"CREDIT_CARD": luhn, "IBAN_CODE": iban}


def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Where personal data stands, in order and without overlaps: of those that overlap the one that begins first stays, then the longest, then the first type by name."""
    digit = _DIGIT.search(text)
    names = [name for name in _PATTERNS if (digit or name == "EMAIL_ADDRESS") and _NEEDS.get(name, "") in text]
    found = sorted((m.start(), -m.end(), name) for name in names for m in _PATTERNS[name].finditer(text) if name not in CHECKS or CHECKS[name](m[0]))
    done = 0
    for start, end, name in found:
        if start >= done:
            done = -end
            yield start, done, name


def mask_text(text: str, types: set[str]) -> str:
    """The text with each span replaced by its type in angle brackets; adds the types that it found."""
    out, at = [], 0
    for start, end, name in spans(text):
        out += [text[at:start], f"<{name}>"]
        types.add(name)
        at = end
    return "".join([*out, text[at:]])


def mask_value(value, types: set[str]):
    """A JSON value with all its texts masked, keys left as they are. A stack instead of recursion: payloads may be nested deeper than Python's calls."""
    top: list = [None]
    todo = [(top, 0, value)]
    while todo:
        into, key, v = todo.pop()
        if isinstance(v, str):
            into[key] = mask_text(v, types)
        elif isinstance(v, dict):
            into[key] = dict.fromkeys(v)
            todo += [(into[key], k, x) for k, x in v.items()]
        elif isinstance(v, list):
            into[key] = [None] * len(v)
            todo += [(into[key], i, x) for i, x in enumerate(v)]
        else:
            into[key] = v
    return top[0]


def mask_one(payload: str | None) -> dict:
    """masked, types and original_sha256 of one payload: JSON, or else a plain text."""
    if payload is None:
        return {"masked": None, "types": None, "original_sha256": None}
    types: set[str] = set()
    try:
        value = json.loads(payload)
        canonical = _sorted_json(value)
        masked = _compact_json(mask_value(value, types))
    except (ValueError, RecursionError):  # no JSON, or deeper than the parser goes: a text
        types.clear()
        canonical, masked = payload, mask_text(payload, types)
    return {"masked": masked, "types": sorted(types), "original_sha256": hashlib.sha256(canonical.encode("utf-8", "surrogatepass")).hexdigest()}


def masked(payload: Column) -> Column:
    """A struct of masked (JSON without spaces, keys in their order), types (sorted) and original_sha256 (of the canonical JSON before masking: keys sorted, ASCII). Null stays null in all three."""

    def run(payloads: pa.Array) -> pa.Array:
        coded = payloads.dictionary_encode()  # equal payloads of a batch are masked once
        rows = [mask_one(p) for p in [*coded.dictionary.to_pylist(), None]]
        kinds = {"masked": pa.string(), "types": pa.list_(pa.string()), "original_sha256": pa.string()}
        found = pa.StructArray.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds.items()], list(kinds))
        return found.take(coded.indices.fill_null(len(rows) - 1))

    return F.arrow_udf(run, "masked string, types array<string>, original_sha256 string")(payload)
