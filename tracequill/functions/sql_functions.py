"""The scanners as SQL functions, and the scanners with several findings as table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tracequill.functions import code_scan, deep_scans, document_layers, masking, text_scans


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'" if "\\" in text else "'" + text.replace("'", "\\'").replace("\n", "\\n") + "'"


def _contained(text: str, words) -> str:
    return f"transform(array({text}), x -> aggregate(array({', '.join(map(_quoted, words))}), 0, (n, w) -> n + CAST(contains(x, w) AS INT)))[0]"


def _count(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, {_quoted(pattern)}, '')))"


def _any(patterns) -> str:
    return " OR ".join(f"regexp_like(t, {_quoted(p)})" for p in patterns)


#: SQL bodies over the parameter t, by name and type: calls are planned like any other expression.
_TOKEN = f"(0.15D * least(1D, {_count(r'\p{Cf}')} / greatest(length(t) * 0.005D, 1D)) + 0.55D * least(1D, {_contained('upper(t)', [d.upper() for d in text_scans.DELIMITERS])} / 2D) + 0.35D * least(1D, {_count(text_scans.OVERRIDE_CHARACTERS)} * 10D))"
_PHRASE = f"least(1D, {_contained('lower(t)', text_scans.PHRASES)} * 0.85D)"
BODIES = {
    "structural_score": ("DOUBLE", f"greatest(0D, least(1D, {_TOKEN} + {_PHRASE} - {_TOKEN} * {_PHRASE}))"),
    "tool_output_score": (
        "DOUBLE",
        "greatest(0D, {}, least(0.78D, 0.6D * ({})))".format(
            *(sep.join(f"CASE WHEN contains(lower(t), {_quoted(p)}) THEN {w}D ELSE 0D END" for p, w, _ in text_scans.TOOL_OUTPUT if (w >= 0.65) == strong) for sep, strong in ((", ", True), (" + ", False)))
        ),
    ),
    "strip_invisible": ("STRING", f"regexp_replace(t, {_quoted('|'.join((text_scans.ZERO_WIDTH, text_scans.BIDI, text_scans.TAGS, text_scans.SELECTORS)))}, '')"),
    "has_credentials": ("BOOLEAN", _any(text_scans.CREDENTIALS.values())),
    "relays_attack": ("BOOLEAN", _any(text_scans.RELAYS.values())),
    "description_risk": ("DOUBLE", "greatest(0D, " + ", ".join(f"CASE WHEN contains(lower(t), {_quoted(p)}) THEN {w}D ELSE 0D END" for p, w in text_scans.DESCRIPTION_SIGNS) + ")"),
}

def _extracted() -> str:
    """Credentials with their labels, as one array over the parameter t."""
    of = ", ".join(f"transform(regexp_extract_all(t, {_quoted(p)}, {g}), v -> named_struct('value', v, 'label', '{name}'))" for p, name, g in text_scans.TAINTS)
    return f"filter(concat({of}), x -> length(x.value) >= 8)"


#: Functions of other parameters, by name: parameters, type and body.
OTHERS = {
    "credentials_in": ("t STRING", "ARRAY<STRUCT<value: STRING, label: STRING>>", _extracted()),
    "canary_token": ("seed STRING", "STRING", "concat('CVT_', upper(sha2(seed, 256)))"),
    "leaks_canary": ("t STRING, token STRING", "BOOLEAN", "coalesce(length(token) > 0 AND (contains(t, token) OR contains(t, 'CVT_')), false)"),
}


@udtf(returnType="score double, pattern string")
class CodeFindings:
    """A row for each risky thing in a Python text, each with the score of the whole; none where it can't be parsed."""

    def eval(self, code: str):
        score, found = code_scan.python_one(code)
        for pattern in found:
            yield score, pattern


@udtf(returnType="threat string, text string")
class HiddenTexts:
    """A row for each hidden text of a PDF or office file."""

    def eval(self, content: bytes):
        yield from document_layers.hidden_texts(content)


@udtf(returnType="path string, value string")
class FlattenArguments:
    """A row for each string in JSON arguments, with its path."""

    def eval(self, arguments: str):
        yield from deep_scans.flatten(arguments)


@udtf(returnType="violation string")
class SchemaViolations:
    """A row for each way in which JSON arguments break a JSON schema."""

    def eval(self, arguments: str, schema: str):
        for v in deep_scans.schema_violations(arguments, schema):
            yield (v,)


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: deep_scans.normalize_one(t)["normalized"])


def _encoding(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: deep_scans.normalize_one(t)["score"])


def _code(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: code_scan.python_one(t)[0])


def _masked(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: masking.mask_one(p)["masked"])


def register(spark: SparkSession) -> None:
    """Makes the scanners known to SQL in this session."""
    for name, (kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    for name, (parameters, kind, body) in OTHERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("python_risk", F.pandas_udf(_code, "double"))
    spark.udf.register("mask_payload", F.pandas_udf(_masked, "string"))
    spark.udtf.register("code_findings", CodeFindings)
    spark.udtf.register("hidden_texts", HiddenTexts)
    spark.udf.register("normalize_text", F.pandas_udf(_normalized, "string"))
    spark.udf.register("encoding_score", F.pandas_udf(_encoding, "double"))
    spark.udtf.register("flatten_arguments", FlattenArguments)
    spark.udtf.register("schema_violations", SchemaViolations)
