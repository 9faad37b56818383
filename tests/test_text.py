import pytest
from pyspark.sql import functions as F

from lodestone.functions.paths import accepted, worktree_key
from lodestone.functions.text import excerpt, whole_word


@pytest.mark.parametrize(("symbol", "lines"), [("Total", [1, 2, 3]), ("GetTotal", [2]), ("otal", []), ("1", [4]), ("Município", [5]), ("Munic", []), ("", []), ("a+b", [6])])
def test_whole_word(spark, symbol, lines):
    rows = [(1, "int Total;"), (2, "var GetTotal = Total + TotalX + Total;"), (3, "Total"), (4, "x = 1;"), (5, "Município"), (6, "(a+b)\\E")]
    df = spark.createDataFrame(rows, "line int, text string")
    assert [r.line for r in df.filter(whole_word(F.col("text"), symbol)).orderBy("line").collect()] == lines


def test_excerpt(spark):
    rows = [("\t" + "a" * 200 + " ",), ("b" * 201,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(excerpt(F.col("t"))).collect()] == ["a" * 200, "b" * 200 + "…"]


def test_paths(spark):
    rows = [("App/A.cs",), ("App/bin/x.txt",), ("App/bin",), ("Lib/B.cs",), ("A/Bin/b/c.cs",), ("app/sub/D.CS",)]
    df = spark.createDataFrame(rows, "path string")
    keep = lambda *a: [r.path for r in df.filter(accepted(F.col("path"), *a)).collect()]
    assert keep() == ["App/A.cs", "App/bin", "Lib/B.cs", "app/sub/D.CS"]
    assert keep(".\\App\\") == ["App/A.cs", "App/bin", "app/sub/D.CS"]
    assert keep(None, ["*.cs"]) == ["App/A.cs", "Lib/B.cs", "app/sub/D.CS"]
    assert keep(None, ["App/*.cs"]) == ["App/A.cs"]
    assert keep(None, ["App/**/*.cs"]) == ["app/sub/D.CS"]
    assert spark.range(1).select(worktree_key(F.lit("E:\\code\\x\\"))).first()[0] == "E__code_x"
