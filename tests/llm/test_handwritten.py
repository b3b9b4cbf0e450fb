"""Problem 3: notices, figures and the forest on held-out files."""

import pytest
from pyspark.sql import functions as F

from codemill.llm.handwritten import FEATURES, fit, head, measured, not_handwritten, noticed, scored_files
from codemill.storage import staged

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "text",
    ["// Code generated by idlc. DO NOT EDIT.\npackage x\n", "# Diese Datei wurde automatisch erzeugt (idlc).\nx = 1\n", "// <auto-generated /> x\nlet a", "/*! lib v4.2 */var a=1", "!function(e,t){/*! lib v0.26 */var a}", "// Copied from lib 6.14; upstream commit d2f371ec1f7b\nlet a", "# SPDX-FileCopyrightText: the lib maintainers\n# Upstream: https://code.invalid/lib\nx = 1"],
)
def test_notices(text):
    assert noticed(text)


@pytest.mark.parametrize("text", ["# The tables below used to be generated; they are now kept by hand.\nx = 1\n", "// Emits files marked as generated, see the template in render.\nlet a", "// Copyright (c) 2021 the lib contributors.\n// Harbour License, version 3.\n", "x = 1\n# Code generated by idlc. DO NOT EDIT.\n", ""])
def test_no_notices(text):
    assert not noticed(text)


def test_head_is_cut_off():
    assert head("// a\n/* b */\ncode // c") == ("// a\n/* b */\n", "code // c")


@pytest.fixture(scope="module")
def files(spark):
    return staged(measured(spark.read.parquet(f"{DATA}/code_records.parquet")), "test-figures")


def test_forest_finds_held_out_notices(files):
    """The features do not see the notice: what the forest says of files that it was not trained on counts."""
    half = F.pmod(F.xxhash64("filePath"), F.lit(2)) == 0
    model = fit(files.where(half))
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rest = model.transform(files.where(~half).withColumn("features", array_to_vector("figures"))).select("filePath", "notice", vector_to_array("probability")[1].alias("p")).collect()
    noticed_ = [r.p >= 0.5 for r in rest if r.notice]
    plain = [r.p >= 0.5 for r in rest if not r.notice]
    assert len(noticed_) > 50 and sum(noticed_) / len(noticed_) >= 0.75
    assert sum(plain) / len(plain) <= 0.05  # tools that write no notice are among them


def _chunk(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, filePath string, content string, startLine int, probability string")


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "/a/x.go", "// Code generated by idlc. DO NOT EDIT.\npackage x", 1, "q"), (1, "/a/x.go", "// Code generated by idlc. DO NOT EDIT.\npackage x", 1, "q"), (2, "/a/y.py", None, 1, None), (3, None, "x", 1, None), (4, "/a/z.py", "", None, None), (None, "/a/w.py", "x", 1, None)]
    assert [r.filePath for r in not_handwritten(_chunk(spark, rows)).collect()] == ["/a/x.go"]
    assert {r.filePath for r in scored_files(_chunk(spark, rows)).collect()} == {"/a/x.go", "/a/y.py", "/a/z.py"}
    assert not_handwritten(_chunk(spark, rows[:0])).count() == 0


def test_key_files_are_no_data_kept_as_code(spark):
    blob = "\n".join("A1b2" * 16 for _ in range(20))
    rows = [(1, "/a/id.pem", blob, 1, ""), (2, "/a/blob.ts", 'export const d =\n' + "\n".join(f'"{x}" +' for x in blob.split("\n")), 1, "")]
    assert [r.filePath for r in not_handwritten(_chunk(spark, rows)).collect()] == ["/a/blob.ts"]
    assert len(FEATURES) == 22
