"""Name functions on odd names."""

from pyspark.sql import functions as F

from sluicebox.functions import names


def test_names(spark):
    rows = [("a/b.PDF.exe",), (".bashrc",), ("x\\y.docx",), ("dir/",), ("pdf.exe",), ("r\u202ecod.txt",)]
    df = spark.createDataFrame(rows, "v string")
    got = {r["v"]: r for r in df.select("v", names.final_extension(F.col("v")).alias("ext"), names.catalog_extension(F.col("v")).alias("cat"), names.double_extension(F.col("v")).alias("dbl"), names.bidi_marks(F.col("v")).alias("bidi")).collect()}
    assert [got[v[0]]["ext"] for v in rows] == ["exe", "bashrc", "docx", None, "exe", "txt"]
    assert got[".bashrc"]["cat"] is None and got["x\\y.docx"]["cat"] == "docx"
    assert [got[v[0]]["dbl"] for v in rows] == [True, False, False, False, False, False]
    assert got["r\u202ecod.txt"]["bidi"] == ["U+202E"]


def test_display_names_are_composed(spark):
    df = spark.createDataFrame([("e\u0301.txt",), ("a/b",), ("..",), (None,)], "v string")
    assert [r[0] for r in df.select(names.display_name(F.col("v"))).collect()] == ["\u00e9.txt", "a_b", "document", None]
