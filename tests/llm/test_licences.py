"""Licence scans: variants of known texts, and the same digests in DuckDB."""

import duckdb
from pyspark.sql import functions as F

from titrant.llm import licences
from titrant.llm.licence_texts import KNOWN


def test_variants_are_found(spark):
    mit = KNOWN["MIT"]
    rows = [
        (1, mit.replace("<year> <copyright holders>", "2019-2024 Ann Other")), (2, mit.upper().replace(",", " ,").replace("\n", "\r\n\n")),
        (3, "/* " + KNOWN["BSD-3-Clause"].replace("\n", "\n * ") + " */"), (4, KNOWN["BSD-2-Clause"] + " And more."), (5, None), (6, ""), (7, "?!"),
        (8, "Some text.\nReleased under the MIT licence\nmore"), (9, "Released under the MIT License. And more."), (10, "Copyright 2020 A\nLicensed under CC BY-NC 4.0.\nall rights reserved\nreleased under the mit license"),
        (None, KNOWN["ISC"]), (8, "other text"), (1, "x " * 300_000), (11, "Licensed under CC BY-NC 4.0."), (11, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licence": F.lit("x"), "own": F.lit(1), "line": F.lit("y")})
    got = sorted((r.doc_id or 0, r.licence, r.line_licences) for r in licences.scan(docs).select("doc_id", F.coalesce("licence", F.lit("")).alias("licence"), F.coalesce("line_licences", F.lit("")).alias("line_licences")).collect())
    nc = "CC-BY-NC-4.0 (line)"
    assert got == sorted([(1, "MIT", ""), (2, "MIT", ""), (3, "BSD-3-Clause", ""), (4, "", ""), (5, "", ""), (6, "", ""), (7, "", ""), (8, "", "MIT (line)"), (9, "", ""),
                          (10, "", nc + ",MIT (line)"), (0, "ISC", ""), (8, "", ""), (1, "", ""), (11, nc, nc), (11, nc, nc)])
    frame = docs.select("doc_id", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(licences.sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in licences.scan(docs).collect())
    assert licences.scan(docs.limit(0)).count() == 0


def test_own_table_of_known_texts(spark):
    known = licences.known_digests(spark, {"own": "The Licence of Ours"})
    docs = spark.createDataFrame([(1, "the license, of ours!")], "doc_id long, text string")
    assert licences.scan(docs, known).first().licence == "own"
