"""Scanners that need Unicode tables, and checks of arguments against a schema: Arrow UDFs over whole batches."""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import json
import re
import unicodedata
import urllib.parse

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that show what a decoded text is up to, invisible characters, and runs that may be encoded.
KEYWORDS = ("ignore", "instructions", "forget", "disregard", "override", "jailbreak", "system", "prompt", "previous", "prior", "above", "unrestricted", "dan", "pretend", "roleplay", "bypass", "restrictions", "restrict", "guidelines", "safety")
INVISIBLE = re.compile("[\u0000\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
TAG = re.compile("[\U000e0000-\U000e007f]")
BASE64_RUN, HEX_RUN, SPACED_RUN = r"(?:[A-Za-z0-9+/]{4}){5,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", r"\b[0-9a-fA-F]{32,}\b", r"(?:[0-9a-fA-F]{2}\s){9,}[0-9a-fA-F]{2}"
PERCENT_RUN = r"(?:%[0-9a-fA-F]{2}){3,}"
B64, HEX, SPACED, PERCENT = (re.compile(p) for p in (BASE64_RUN, HEX_RUN, SPACED_RUN, PERCENT_RUN))
ROT13, REVERSED = (tuple(codecs.encode(k, "rot13") for k in KEYWORDS), tuple(k[::-1] for k in KEYWORDS))
_MARKS = regex.compile(r"\p{Mn}+")


def _said(text: str, words: tuple[str, ...] = KEYWORDS) -> bool:
    low = text.lower()
    return any(w in low for w in words)


def _unhexed(digits: str) -> str:
    return bytes.fromhex(digits[: len(digits) // 2 * 2]).decode("utf-8", "ignore")


def _decoded(text: str, pattern: re.Pattern, decode) -> tuple[str, bool, bool]:
    """The text with its first run that hides a keyword decoded; whether there was one, and whether a run before it held a text over 12 characters."""
    plain = False
    for run in pattern.findall(text):
        try:
            found = decode(run)
        except (ValueError, binascii.Error):
            continue
        if len(found) < 6:
            continue
        if _said(found):
            return text.replace(run, f" {found} ", 1), True, plain
        plain = plain or len(found) > 12
    return text, False, plain


def normalize_one(text: str | None) -> dict:
    """normalized, invisible_count, encodings and score; the score is the largest of the steps' scores."""
    out = text or ""
    scores, encodings = [0.0], []
    tags, invisible = len(TAG.findall(out)), len(INVISIBLE.findall(out))

    def saw(name: str, score: float) -> None:
        encodings.append(name)
        scores.append(score)

    if tags or invisible:
        out = TAG.sub("", INVISIBLE.sub("", out))
        scores.append(min(1.0, 0.15 * invisible))
        if tags:
            saw("unicode_tag_chars", min(1.0, 0.30 * tags))
    out = html.unescape(out)
    if PERCENT.search(out) and (plain := urllib.parse.unquote(out)) != out:
        out = plain
        saw("url_encoded", 0.30)
    if (composed := unicodedata.normalize("NFKC", out)) != out:
        out = composed
        saw("fullwidth_unicode", 0.50)
    if not out.isascii():
        bare = _MARKS.sub("", unicodedata.normalize("NFD", out))
        if len(out) - len(bare) >= 2:  # letters that carry their accent count none
            saw("combining_diacritics", 0.40)
        out = bare
    out, hidden, plain = _decoded(out, B64, lambda r: base64.b64decode(r + "=" * (-len(r) % 4)).decode("utf-8", "ignore"))
    if hidden or plain:
        saw("base64", 0.75 if hidden else 0.40)
    out, hidden, _ = _decoded(out, SPACED, lambda r: _unhexed(r.replace(" ", "").replace("\t", "")))
    if hidden:
        saw("hex_spaced", 0.75)
    out, hidden, _ = _decoded(out, HEX, _unhexed)
    if hidden:
        saw("hex", 0.70)
    # a text whose turned form says a word holds the turned word
    for name, score, words, turn in (("rot13", 0.80, ROT13, lambda t: codecs.encode(t, "rot13")), ("reversed", 0.75, REVERSED, lambda t: t[::-1])):
        if _said(out, words) and not _said(out):
            out = f"{out} {turn(out)}"
            saw(name, score)
    if len(out) > 40 and not encodings and out.count(" ") / len(out) < 0.04 and sum(map(str.isalnum, out)) / len(out) > 0.90:
        saw("high_cpt_density", 0.25)
    return {"normalized": out, "invisible_count": invisible, "encodings": list(dict.fromkeys(encodings)), "score": max(scores), "modified": out != (text or "")}


_NORMALIZED = "normalized string, invisible_count long, encodings array<string>, score double, modified boolean"


def normalize(text: Column) -> Column:
    """A struct of normalized, invisible_count, encodings, score and modified; that of an empty text for null."""
    names = ["normalized", "invisible_count", "encodings", "score", "modified"]

    def run(texts: pa.Array) -> pa.Array:
        found = [normalize_one(t) for t in texts.to_pylist()]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)], names)

    return F.arrow_udf(run, _NORMALIZED)(text)


def flatten(arguments: str | None) -> list[tuple[str, str]]:
    """Dotted paths and values of all strings in a JSON text."""
    try:
        top = json.loads(arguments or "{}")
    except ValueError:
        return [("", arguments)]
    out: list[tuple[str, str]] = []

    def walk(path: str, x) -> None:
        if isinstance(x, str):
            out.append((path, x))
        elif isinstance(x, dict):
            for k, v in x.items():
                walk(f"{path}.{k}" if path else k, v)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(f"{path}[{i}]", v)

    walk("", top)
    return out


def schema_violations(arguments: str | None, schema: str | None, at: str = "") -> list[str]:
    """Ways in which JSON arguments break a JSON schema: required, type, enum, length, range, items and additional properties."""
    try:
        value, rule = json.loads(arguments or "{}"), json.loads(schema or "{}")
    except ValueError:
        return ["not JSON"]
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
    out: list[str] = []

    def walk(v, s: dict, at: str) -> None:
        k = s.get("type")
        if k in kinds and not isinstance(v, kinds[k]):
            out.append(f"{at}: not of type {k}")
            return
        if "enum" in s and v not in s["enum"]:
            out.append(f"{at}: not one of the values")
        if isinstance(v, str):
            if len(v) < s.get("minLength", 0) or len(v) > s.get("maxLength", len(v)):
                out.append(f"{at}: length")
        elif isinstance(v, (int, float)):
            if v < s.get("minimum", v) or v > s.get("maximum", v):
                out.append(f"{at}: range")
        elif isinstance(v, list):
            for i, x in enumerate(v[:20]):
                walk(x, s.get("items", {}), f"{at}[{i}]")
        elif isinstance(v, dict):
            known = s.get("properties", {})
            out.extend(f"{at}.{n}: missing" for n in s.get("required", []) if n not in v)
            if s.get("additionalProperties") is False:
                out.extend(f"{at}.{n}: unknown" for n in v if n not in known)
            for n, x in v.items():
                if n in known:
                    walk(x, known[n], f"{at}.{n}")

    walk(value, rule, at or "$")
    return out


def schema_check(arguments: Column, schema: Column) -> Column:
    return F.pandas_udf(lambda a, s: pd.Series([schema_violations(x, y) for x, y in zip(a, s, strict=True)]), "array<string>")(arguments, schema)
