import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwright.sources import gene_sets, matrix, tables


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id, score ,label\nA,1.5,x\nB,NA,null\nC,n/a,y\n")
    df = tables.trim_columns(tables.read_table(spark, str(tmp_path / "t.csv")))
    assert dict(df.dtypes) == {"id": "string", "score": "double", "label": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("A", 1.5, "x"), ("B", None, None), ("C", None, "y")]


def test_csv_with_schema_casts_bad_values_to_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n\nA,1\nB,oops\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "t.csv"), schema).orderBy("id").collect()] == [("A", 1), ("B", None)]


def test_optional_and_required(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    assert tables.read_optional(spark, str(tmp_path / "none.csv"), schema).count() == 0
    assert tables.read_optional(spark, None, schema).schema == schema
    with pytest.raises(KeyError):
        tables.require_columns(spark.createDataFrame([("a",)], "id string"), ["id", "x"])


def test_repeated_labels(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,kind,kind\n1,,b\n2,A.1,a-1\n3,x,y\n")
    from cohortwright.operators.keys import resolve_duplicate_columns

    merged, report = resolve_duplicate_columns(*tables.read_labelled(spark, str(tmp_path / "t.csv")))
    assert [tuple(r) for r in merged.orderBy("id").collect()] == [("1", "b"), ("2", "A.1"), ("3", "x")]
    assert tuple(report.first()) == ("kind", 1, 1)


def test_orientation():
    assert matrix.is_gene_by_sample(["gene", "TCGA-1", "tcga.2", "TCGA-3"])
    assert not matrix.is_gene_by_sample(["barcode", "G1", "G2", "G3"])
    assert not matrix.is_gene_by_sample(["gene", "TCGA-1", "TCGA-2"])


def test_wide_text_matrix_both_ways(spark, tmp_path):
    (tmp_path / "a.csv").write_text('gene,"TCGA-1","TCGA-2",TCGA-3\n"g1",1,NA,3\ng2,4,5,6\n')
    rows = {(r["sample_id"], r["gene"]): r["value"] for r in matrix.read_wide_matrix(spark, str(tmp_path / "a.csv")).collect()}
    assert len(rows) == 6 and rows["TCGA-2", "g1"] is None and rows["TCGA-3", "g2"] == 6.0
    (tmp_path / "b.csv").write_text("barcode,g1,g2\ns1,1,2\ns2,3,nan\n")
    rows = {(r["sample_id"], r["gene"]): r["value"] for r in matrix.read_wide_matrix(spark, str(tmp_path / "b.csv")).collect()}
    assert rows == {("s1", "g1"): 1.0, ("s1", "g2"): 2.0, ("s2", "g1"): 3.0, ("s2", "g2"): None}


def test_wide_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene,TCGA-1,TCGA-2,TCGA-3\ng1,1,2,3\n")
    (tmp_path / "b.csv").write_text("barcode,g1,g2\nTCGA-9,7,8\n\n")
    rows = {(r["sample_id"], r["gene"]): r["value"] for r in matrix.read_wide_matrix(spark, str(tmp_path)).collect()}
    assert rows == {("TCGA-1", "g1"): 1.0, ("TCGA-2", "g1"): 2.0, ("TCGA-3", "g1"): 3.0, ("TCGA-9", "g1"): 7.0, ("TCGA-9", "g2"): 8.0}
    (tmp_path / "c.csv").write_text("barcode,g1,g2\ns1,1\n")
    with pytest.raises(Exception, match="another number of cells"):
        matrix.read_wide_matrix(spark, str(tmp_path / "c.csv")).collect()


def test_wide_files_keep_repeated_header_lines_as_data(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.csv").write_text(f"barcode,g1,g{i + 2}\ns{i},1,2\nbarcode,g1,g{i + 2}\n")
    out = matrix.read_wide_matrix(spark, str(tmp_path))
    rows = out.collect()
    assert len(rows) == 48 and sum(r["sample_id"] == "barcode" and r["value"] is None for r in rows) == 24
    assert {(r["gene"], r["value"]) for r in rows if r["sample_id"] == "s7"} == {("g1", 1.0), ("g9", 2.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_gene_sets(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("S1\tdesc\tA\tB\tA\t\nshort\tx\nS2\td\tC\n")
    got = {tuple(r) for r in gene_sets.read_gene_sets(spark, str(tmp_path / "a.gmt")).collect()}
    assert got == {("S1", "A"), ("S1", "B"), ("S2", "C")}
    (tmp_path / "b.gmt").write_text("S1\td\tA\nS1\td\tB\n")
    with pytest.raises(ValueError, match="S1"):
        gene_sets.read_gene_sets(spark, str(tmp_path / "b.gmt"))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    tables.write_table(df, str(tmp_path / "csv"), "csv")
    back = tables.read_table(spark, str(tmp_path / "csv"), df.schema, "csv")
    assert sorted(back.collect()) == sorted(df.collect())
    nested = df.select(F.struct("n", "s").alias("x"))
    tables.write_summary(nested, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select("x.n").count() == 2
