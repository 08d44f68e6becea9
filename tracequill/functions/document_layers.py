"""Hidden layers of office documents and PDF files: text that a reader doesn't see, macros and scripts.

Files come as binary rows (spark.read.format("binaryFile")) or as base64 in the output of a tool. layers() tells what a file hides; injections() holds the hidden texts against the signs of
injection: tasks only take the texts out of the files and find signs in them, weights and thresholds are column expressions. Of PDF files, objects are found by their numbers and not by the cross-reference table,
so broken ones are read too; streams packed with Flate are unpacked, object streams included, and others are not read. Fonts with an encoding of their own give no readable text.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequill.functions import text_scans
from tracequill.functions.automaton import built, places

#: Scores of what runs, and of text that is hidden in a document.
RUNS, HIDDEN = 0.90, 0.40
#: Bytes that a packed part may take once unpacked; a larger part is reported, not read.
MOST = 64 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _office(data: bytes) -> list[tuple[str, float, str]]:
    found: list[tuple[str, float, str]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            name = info.filename
            if name.lower().endswith("vbaproject.bin"):
                found.append(("macro", RUNS, name))
            if not name.endswith(".xml"):
                continue
            if info.file_size > MOST:
                found.append(("oversized_part", HIDDEN, name))
                continue
            root = ElementTree.fromstring(z.read(info))
            if name.startswith("word/comments"):
                text = "".join(root.itertext()).strip()
                if text:
                    found.append(("comment", HIDDEN, text))
            for run in root.iter(f"{_W}r"):
                style = run.find(f"{_W}rPr")
                if style is None:
                    continue
                colour, size = style.find(f"{_W}color"), style.find(f"{_W}sz")
                hidden = style.find(f"{_W}vanish") is not None
                white = colour is not None and (colour.get(f"{_W}val") or "").upper() == "FFFFFF"
                tiny = size is not None and (size.get(f"{_W}val") or "99").isdigit() and int(size.get(f"{_W}val") or "99") <= 2
                text = "".join(t.text or "" for t in run.iter(f"{_W}t"))
                if text.strip() and (hidden or white or tiny):
                    found.append(("hidden_text" if hidden else "white_text" if white else "tiny_text", HIDDEN, text))
    return found


def _pdf(data: bytes) -> list[tuple[str, float, str]]:
    found = [(name, RUNS, name) for name, pattern in (("javascript", rb"/(?:JavaScript|JS)\b"), ("launch_action", rb"/Launch\b")) if re.search(pattern, data)]
    if re.search(rb"(?<![0-9])3\s+Tr\b", data):
        found.append(("invisible_text", HIDDEN, "text rendering mode 3"))
    return found


def layers_one(data: bytes | None) -> dict:
    """The worst layer of a file: threat, score and detail; all layers' texts in texts. What can't be read has the threat unreadable and score 0."""
    try:
        found = _office(data) if data and data[:4] == b"PK\x03\x04" else _pdf(data) if data and data[:4] == b"%PDF" else []
    except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, EOFError, NotImplementedError, RuntimeError):
        found = [("unreadable", 0.0, "")]
    worst = max(found, key=lambda x: x[1], default=("", 0.0, ""))
    return {"threat": worst[0], "score": worst[1], "detail": worst[2], "texts": [x[2] for x in found if x[1] == HIDDEN]}


def layers(content: Column) -> Column:
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([layers_one(x) for x in s], columns=["threat", "score", "detail", "texts"])

    return F.pandas_udf(run, "threat string, score double, detail string, texts array<string>")(content)


#: Threats by layer, and the score of its text that must be passed; scripts and macros count alone.
THRESHOLDS = {
    "pdf_hidden_text": 0.35, "pdf_annotation_injection": 0.30, "pdf_metadata_injection": 0.35, "docx_hidden_text": 0.30, "docx_comment_injection": 0.30, "docx_metadata_injection": 0.35, "docx_track_changes_injection": 0.40,
}
ALONE = ("pdf_javascript", "docx_macro_detected")
#: Fixed value: texts of comments, properties and deletions up to this length say nothing.
SHORT = 8
#: Fill colours from this share of white on, and sizes below this one, are not seen.
WHITE, TINY = 0xF0 / 0xFF, 0.5
_STREAM = re.compile(rb"<<((?:[^<>]|<[^<>]*>|<<(?:[^<>]|<[^<>]*>|<<[^<>]*>>)*>>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_STRING = rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>"
_TOKEN = re.compile(_STRING + rb"|[\[\]]|/[^\s/\[\]()<>%]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"]+\*?|%[^\r\n]*", re.S)
_ANNOTATION = re.compile(rb"/Contents\s*(" + _STRING + rb")", re.S)
_INFO = re.compile(rb"/(?:Title|Author|Subject|Keywords|Creator|Producer)\s*(" + _STRING + rb")", re.S)
_SCRIPT = re.compile(rb"/(?:JavaScript|JS)\b")
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _unpacked(head: bytes, data: bytes) -> bytes:
    """A stream's content if it is plain or packed with Flate alone, at most MOST bytes of it; else nothing."""
    filters = re.findall(rb"/(\w+Decode|Crypt)\b", head)
    if not filters:
        return data
    if filters != [b"FlateDecode"]:
        return b""
    try:
        return zlib.decompressobj().decompress(data, MOST)
    except zlib.error:
        return b""


def _string(token: bytes) -> str:
    """A PDF string: UTF-16 with its mark, else UTF-8 if it is that, else one byte a character."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _ESCAPED.get(m[1], m[1]), token[1:-1])
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _unseen(content: bytes) -> list[str]:
    """Texts that a page's operators (if the stream holds some) draw in no colour but the paper's, too small, or not at all. Lines of one look are one text."""
    if not re.search(rb"\bT[jJ]\b|['\"]", content):
        return []
    white, mode, size, scale = False, 0, 12.0, 1.0
    kept, args, out, last = [], [], [], False
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/%" or t[:1] in b"+-.0123456789":
            args.append(t)
            continue
        numbers = [float(x) for x in args if re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", x)]
        if t == b"q":
            kept.append((white, mode, size, scale))
        elif t == b"Q" and kept:
            white, mode, size, scale = kept.pop()
        elif t in (b"rg", b"g", b"sc", b"scn") and numbers:
            white = min(numbers) >= WHITE
        elif t == b"k" and numbers:
            white = max(numbers) <= 1 - WHITE
        elif t == b"Tr" and numbers:
            mode = int(numbers[-1])
        elif t == b"Tf" and numbers:
            size = abs(numbers[-1])
        elif t == b"Tm" and len(numbers) >= 6:
            scale = (numbers[-4] ** 2 + numbers[-3] ** 2) ** 0.5
        elif t == b"BT":
            scale = 1.0
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            text = "".join(_string(x) for x in args if x[:1] in (b"(", b"<"))
            hidden = white or mode == 3 or size * scale < TINY
            if hidden and text:
                if last:
                    out[-1] += ("" if t in (b"Tj", b"TJ") else " ") + text
                else:
                    out.append(text)
            last = hidden
        elif t in (b"T*", b"Td", b"TD") and last and out:
            out[-1] += " "
        args = []
    return [x.strip() for x in out if x.strip()]


def _pdf_texts(data: bytes) -> list[tuple[str, str]]:
    out, packed = [], []  # one stream is held at a time, but for those of objects
    for m in _STREAM.finditer(data):
        content = _unpacked(m[1], m[2])
        if re.search(rb"/ObjStm\b", m[1]):
            packed.append(content)
        else:
            out += [("pdf_hidden_text", x) for x in _unseen(content)]
    objects = b"\n".join([_STREAM.sub(lambda m: b"<<" + m[1] + b">>", data), *packed])
    out += [("pdf_annotation_injection", _string(x).strip()) for x in _ANNOTATION.findall(objects)]
    out += [("pdf_metadata_injection", x) for x in map(_string, _INFO.findall(objects)) if len(x) > SHORT]
    return out + [("pdf_javascript", "")] * bool(_SCRIPT.search(objects))


def _office_texts(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {i.filename: i for i in z.infolist()}
        out += [("docx_macro_detected", "")] * any(n.lower().endswith("vbaproject.bin") for n in names)

        def root(name: str):
            return ElementTree.fromstring(z.read(name)) if name in names and names[name].file_size <= MOST else ElementTree.Element("none")

        body = root("word/document.xml")
        for run in body.iter(f"{_W}r"):
            style = run.find(f"{_W}rPr")
            if style is not None and style.find(f"{_W}vanish") is not None:
                out.append(("docx_hidden_text", "".join(t.text or "" for t in run.iter(f"{_W}t"))))
        out += [("docx_track_changes_injection", x) for x in (" ".join(e.text for e in d.iter() if e.text).strip() for d in body.iter(f"{_W}del")) if len(x) > SHORT]
        for threat, parts in (("docx_comment_injection", ("word/comments.xml", "word/commentsExtended.xml")), ("docx_metadata_injection", ("docProps/core.xml", "docProps/app.xml"))):
            out += [(threat, e.text.strip()) for p in parts for e in root(p).iter() if e.text and len(e.text.strip()) > SHORT]
    return out


def hidden_texts(data: bytes | None) -> list[tuple[str, str]]:
    """(threat, text) of each hidden text of a file; scripts and macros have no text. Other files, null and what can't be read give none."""
    try:
        return _office_texts(data) if data and data[:4] == b"PK\x03\x04" else _pdf_texts(data) if data and data[:4] == b"%PDF" else []
    except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return []


def injections(content: Column) -> Column:
    """The worst threat in a file's hidden layers and its score, with all threats by name, the worst first: threat (null if there is none), score, threats."""

    def run(s: pd.Series) -> pd.Series:
        signs = built(text_scans.SIGNS)
        return pd.Series([[{"threat": threat, "places": places(text.lower(), signs)} for threat, text in hidden_texts(x)] for x in s])

    found = F.pandas_udf(run, "array<struct<threat:string,places:array<int>>>")(content)
    least = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    scored = lambda v: F.transform(v, lambda x: F.struct(F.when(x["threat"].isin(*ALONE), F.lit(-RUNS)).otherwise(-text_scans._weighed(x["places"])).alias("less"), x["threat"].alias("threat")))
    over = lambda v: F.filter(v, lambda x: x["threat"].isin(*ALONE) | (-x["less"] > F.try_element_at(least, x["threat"])))
    as_struct = lambda v: F.struct(F.try_element_at(v, F.lit(1))["threat"].alias("threat"), F.coalesce(-F.try_element_at(v, F.lit(1))["less"], F.lit(0.0)).alias("score"), F.array_distinct(v["threat"]).alias("threats"))
    return text_scans.let(text_scans.let(found, lambda v: F.array_sort(over(scored(v)))), as_struct)


def file_in(text: Column) -> Column:
    """The file that a tool's output is, as it stands or in base64; null if it is none."""
    coded = (F.length(text) > 100) & F.substring(text, 1, 4).isin("JVBE", "UEsD")
    return F.when(F.startswith(text, F.lit("%PDF")), F.encode(text, "UTF-8")).when(coded, F.try_to_binary(text, F.lit("base64")))


def tool_output_scan(text: Column, most_bytes: int | None = None) -> Column:
    """text_scans.tool_output_scan() with the layers of a file that the output is: its worst threat raises the score, and is named doc:<threat>. Adds doc_threat (null if none)."""
    both = F.struct(text_scans.tool_output_scan(text, most_bytes).alias("s"), injections(file_in(text)).alias("d"))

    def joined(v: Column) -> Column:
        s, d = v["s"], v["d"]
        score = F.greatest(s["score"], d["score"])
        of = F.when(d["threat"].isNotNull(), F.array(F.concat(F.lit("doc:"), d["threat"]))).otherwise(F.array().cast("array<string>"))
        level = F.when(score < 0.35, "safe").when(score < 0.65, "suspicious").otherwise("injection")
        return F.struct(score.alias("score"), level.alias("label"), (score >= 0.65).alias("detected"), F.concat(of, s["threats"]).alias("threats"), s["stego_severity"].alias("stego_severity"), d["threat"].alias("doc_threat"))

    return text_scans.let(both, joined)
