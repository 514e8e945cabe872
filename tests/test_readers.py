import pytest

from ledgerloom.sources import readers as R
from ledgerloom.sources.spec import RefSpec


def test_csv_in_both_encodings(spark, tmp_path):
    for encoding in ("utf-8", "latin1"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes("Key,Name,Total\n1,Zoë,5\n2,N/A,\n".encode(encoding))
        assert R.dialect(spark, str(path)) == ("UTF-8" if encoding == "utf-8" else "ISO-8859-1", False)
        assert [tuple(r) for r in R.read_table(spark, str(path)).collect()] == [("1", "Zoë", "5"), ("2", None, None)]
        assert R.header(spark, str(path)) == ["Key", "Name", "Total"]


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('Key,Name,Total\n1,"say ""hi"", then",5\n2,"two\nlines",6\n3,"tail\\",7\n4,a\\"b,8\n')
    assert R.dialect(spark, str(path)) == ("UTF-8", True)
    want = [("1", 'say "hi", then', "5"), ("2", "two\nlines", "6"), ("3", "tail\\", "7"), ("4", 'a\\"b', "8")]
    assert [tuple(r) for r in R.read_table(spark, str(path)).collect()] == want
    assert [tuple(r) for r in R.read_table(spark, str(path), ["Total"], encoding="UTF-8", multi_line=True).collect()] == [(t,) for _, _, t in want]
    plain = tmp_path / "p.csv"
    plain.write_text('Key,Name\n1,"a ""b"" c"\n')
    assert R.dialect(spark, str(plain)) == ("UTF-8", False)
    assert R.read_table(spark, str(plain)).first()["Name"] == 'a "b" c'


def test_columns_are_a_set(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("A,B,C,D\n1,2,3,4\n")
    assert R.read_table(spark, str(path), ["C", "A"]).columns == ["A", "C"]
    assert R.read_table(spark, str(path)).columns == ["A", "B", "C", "D"]


def test_other_formats(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t.parquet"))
    assert R.read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError):
        R.read_table(spark, "x.xlsx")


def test_pruning_reaches_the_scan(spark, small):
    plan = R.read_table(spark, f"{small}/orders.parquet", ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_strict_subset_and_problems(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["k", "a", "Open Amount", "Terms"])
    ref = RefSpec("R", "k", ("a", "k"))
    subset, amount = R.strict_subset(df, ref)
    assert (subset.columns, amount) == (["k", "a", "Open Amount"], "Open Amount")
    assert R.extracted(ref) == ["a", "k"] and R.extracted(RefSpec("R", "k", ("a",))) == ["k", "a"]
    assert R.problems([(RefSpec("R", "gone", ("x",)), df)]) == [("R", "missing column: gone, x")]
