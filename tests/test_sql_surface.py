"""Scanners by SQL name against the same scanners as columns."""

from pyspark.sql import functions as F

from tracequill.functions import code_scan, masking, sql_functions, text_scans


def test_credentials_canaries_and_code(spark):
    sql_functions.register(spark)
    texts = ["", "nothing", "use AKIA" + "A1" * 8 + " and Bearer " + "x" * 30, "api_key = '" + "k" * 20 + "' sk-" + "b" * 24, "password: hunter2hunter2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("surface_texts")
    got = [r[0] for r in spark.sql("SELECT credentials_in(t) FROM surface_texts").collect()]
    assert got == [r[0] for r in df.select(text_scans.credentials(F.col("t"))).collect()] and len(got[2]) == 2
    r = spark.sql("SELECT canary_token('s') AS c, leaks_canary(concat('it is ', canary_token('s')), canary_token('s')) AS y, leaks_canary('it is', canary_token('s')) AS n, leaks_canary(NULL, NULL) AS z").first()
    assert (r["c"], r["y"], r["n"], r["z"]) == (spark.range(1).select(text_scans.canary(F.lit("s"))).first()[0], True, False, False)
    code = "import os\nos.system('ls')"
    score, found = code_scan.python_one(code)
    spark.createDataFrame([(code,), ("x = 1",), ("not code at all",), (None,)], "code string").createOrReplaceTempView("surface_code")
    assert [x[0] for x in spark.sql("SELECT python_risk(code) FROM surface_code").collect()] == [score, 0.0, 0.0, 0.0] and score > 0.7
    rows = spark.sql("SELECT f.* FROM surface_code, LATERAL code_findings(code) f").collect()
    assert [tuple(x) for x in rows] == [(score, p) for p in found]


def test_masking_and_hidden_texts(spark):
    sql_functions.register(spark)
    payload = '{"a": ["mail me at x@example.com"], "n": 1}'
    spark.createDataFrame([(payload,), (None,)], "p string").createOrReplaceTempView("surface_payloads")
    assert [r[0] for r in spark.sql("SELECT mask_payload(p) FROM surface_payloads").collect()] == [masking.mask_one(payload)["masked"], masking.mask_one(None)["masked"]]
    pdf = b"%PDF-1.4 1 0 obj << /Type /Annot /Contents (a note) >> endobj 2 0 obj << /JS (x) >>"
    spark.createDataFrame([(bytearray(pdf),), (None,)], "c binary").createOrReplaceTempView("surface_files")
    assert sorted(map(tuple, spark.sql("SELECT h.* FROM surface_files, LATERAL hidden_texts(c) h").collect())) == [("pdf_annotation_injection", "a note"), ("pdf_javascript", "")]
