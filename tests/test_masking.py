"""Masking of payloads: checks, overlaps, depth, hashes."""

import hashlib
import json

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tracequill.functions import masking


@pytest.mark.parametrize(("number", "right"), [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("5500-0000-0000-0004", True), ("411111111111", False)])
def test_luhn(number, right):
    assert masking.luhn(number) is right


@pytest.mark.parametrize(("number", "right"), [("GB82WEST12345698765432", True), ("GB82WEST12345698765433", False), ("DE89370400440532013000", True)])
def test_iban(number, right):
    assert masking.iban(number) is right


@pytest.mark.parametrize(("text", "want", "types"), [
    ("mail a.b@example.org now", "mail <EMAIL_ADDRESS> now", ["EMAIL_ADDRESS"]),
    ("ssn 123-45-6789, ip 10.0.0.1", "ssn <US_SSN>, ip <IP_ADDRESS>", ["IP_ADDRESS", "US_SSN"]),
    ("card 4111111111111111 and 4111111111111112", "card <CREDIT_CARD> and 4111111111111112", ["CREDIT_CARD"]),
    ("at x@10.0.0.1 too", "at <EMAIL_ADDRESS> too", ["EMAIL_ADDRESS"]),  # the address stands within the mail address
    ("", "", []),
    ("nothing here", "nothing here", []),
])
def test_texts(text, want, types):
    seen: set[str] = set()
    assert masking.mask_text(text, seen) == want and sorted(seen) == types


def test_payloads(spark):
    deep = {"a": "123-45-6789"}
    for _ in range(300):
        deep = {"x": [deep]}
    rows = [json.dumps({"b": ["u@example.org", {"c": 1.5, "d": None, "e": True}], "a": "é 10.0.0.1"}), json.dumps("u@example.org"), "not JSON u@example.org", "{}", "[]", "", None, "7", json.dumps(deep), '{"k": "1", "k": "10.0.0.1"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", masking.masked(F.col("t")).alias("m")).collect()}
    assert got[0]["masked"] == '{"b":["<EMAIL_ADDRESS>",{"c":1.5,"d":null,"e":true}],"a":"é <IP_ADDRESS>"}' and got[0]["types"] == ["EMAIL_ADDRESS", "IP_ADDRESS"]
    assert got[0]["original_sha256"] == hashlib.sha256(json.dumps(json.loads(rows[0]), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [got[i]["masked"] for i in range(1, 8)] == ['"<EMAIL_ADDRESS>"', "not JSON <EMAIL_ADDRESS>", "{}", "[]", "", None, "7"]
    assert got[6]["types"] is None and got[8]["types"] == ["US_SSN"] and "123-45" not in got[8]["masked"] and got[8]["masked"].count("x") == 300
    assert got[9]["masked"] == '{"k":"<IP_ADDRESS>"}'  # the last of a key counts


def test_documents_against_a_plain_walk(spark, sf):
    from tracequill.plans import registry

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["masked_documents"](spark, sf).collect():
        types: set[str] = set()
        text = docs[r["doc_id"]]["text"]
        parts = [None if text is None else masking.mask_text(text, types)]
        masked = json.dumps({"parts": parts, "source": docs[r["doc_id"]]["source"]}, separators=(",", ":"), ensure_ascii=False)
        assert (r["types"], r["masked_sha256"]) == (",".join(sorted(types)), hashlib.sha256(masked.encode()).hexdigest())


def test_equal_payloads_are_masked_once(spark, monkeypatch):
    calls = []
    one = masking.mask_one
    monkeypatch.setattr(masking, "mask_one", lambda p: calls.append(p) or one(p))
    made = []
    monkeypatch.setattr(F, "arrow_udf", lambda run, kind: made.append(run) or (lambda c: c))
    masking.masked(F.lit(1))
    texts = [None, '{"a":"x@y.org"}', "no digits", '{"a":"x@y.org"}', "4111 1111 1111 1111", None, "1.2.3.4 or +44 20 7946 0958"] * 50
    got = made[0](pa.array(texts, pa.string())).to_pylist()
    assert got == [one(t) for t in texts]
    assert len(calls) <= 5
    assert made[0](pa.array([], pa.string())).to_pylist() == [] and made[0](pa.array([None], pa.string())).to_pylist() == [one(None)]
