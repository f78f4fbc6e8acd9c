"""Readers, writers, the facade, generated code, reports, training, the command line and the driver's entry."""

import ast
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay import catalog, cli
from assay.operators import training
from assay.session import Session
from assay.sources.readers import Dataset
from assay.sources.writers import embed, write_csv

RECORDS = [{"a": i, "b": {"c": f"v{i}", "d": {"e": i / 2}}} for i in range(5)]


def test_json_forms(spark, tmp_path):
    for name, text in (("plain", json.dumps(RECORDS)), *[(k, json.dumps({k: RECORDS, "n": 1})) for k in ("data", "records", "rows", "results", "items")]):
        (tmp_path / f"{name}.json").write_text(text)
        got = Dataset.load(spark, str(tmp_path / f"{name}.json")).df
        assert sorted(got.columns) == ["a", "b.c", "b.d.e"] and got.count() == 5, name
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, RECORDS)))
    assert Dataset.load(spark, str(tmp_path / "x.jsonl")).df.select("`b.d.e`").count() == 5


def test_files(spark, tmp_path):
    frame = pd.DataFrame({"a": [1, 2, 3], "s": ["x", "y", None]})
    frame.to_csv(tmp_path / "t.csv", index=False)
    frame.to_csv(tmp_path / "t.TSV", index=False, sep="\t")
    frame.to_parquet(tmp_path / "t.parquet")
    frame.to_feather(tmp_path / "t.feather")
    frame.to_pickle(tmp_path / "t.pkl")
    (tmp_path / "t.xml").write_text("<?xml version='1.0'?><root><rec><a>1</a><s>x</s></rec><rec><a>2</a><s>y</s></rec><rec><a>3</a></rec></root>")
    for name in ("t.csv", "t.TSV", "t.parquet", "t.feather", "t.xml"):
        d = Dataset.load(spark, str(tmp_path / name))
        assert d.name == "t" and sorted(d.df.columns) == ["a", "s"] and d.df.count() == 3, name
    assert Dataset.load(spark, str(tmp_path / "t.pkl"), unsafe=True).df.count() == 3
    for path, error in (("t.pkl", ValueError), ("t.exe", ValueError), ("absent.csv", FileNotFoundError)):
        with pytest.raises(error):
            Dataset.load(spark, str(tmp_path / path))
    for data in (frame, frame.to_dict("list"), RECORDS[:0] or [{"a": 1}], np.arange(6).reshape(3, 2), spark.range(2)):
        assert Dataset.load(spark, data).name == "dataset"
    assert open(write_csv(spark.range(3).coalesce(1), str(tmp_path / "o/out.csv"))).read().split() == ["id", "0", "1", "2"]
    assert "</" not in embed("</script>")


@pytest.fixture(scope="module")
def staff(spark):
    rows = [(20 + i * 7 % 45, float(30_000 + (i * 7919) % 50_000), None if i % 3 else float(i % 100), ["Sales", "IT", "HR"][i % 3], f"2020-{1 + i % 12:02d}-01", i % 4 == 0) for i in range(300)]
    return spark.createDataFrame(rows, "age int, income double, score double, department string, joined string, churn boolean").withColumn("joined", F.to_timestamp("joined")).cache()


def test_session(spark, staff, tmp_path):
    s = Session(spark, staff, "staff", "churn")
    a = s.analyze()
    assert a["overview"]["n_rows"] == 300 and a["readiness"]["columns"] and a["leakage"]["risk"] in ("CLEAN", "MODERATE", "HIGH", "CRITICAL") and len(a["narrative"]) == 13
    s.apply("drop_high_missing").apply("scale_standard", ["income"])
    assert "score" not in s.get_dataframe().columns and [h["action"] for h in s.pipeline_summary()] == ["drop_high_missing", "scale_standard"] and s.pipeline_summary(count=True)[-1]["rows_now"] == 300
    page = open(s.compare(str(tmp_path / "r/compare.html"))).read()
    assert "Before" in page and "After" in page and "Readiness" in page and "Leakage" in page
    assert open(s.profile(str(tmp_path / "p.html"))).read().startswith("<!DOCTYPE html>")
    code = s.generate_pipeline_code()
    assert "RandomForestClassifier" in code and ast.parse(code)
    assert s.drift(staff.withColumn("income", F.col("income") * 2), str(tmp_path / "d.html"))["n_columns"] > 0
    assert s.readiness_score()["grade"] in "ABCDF" and s.recommend()
    assert "score" in s.reset().get_dataframe().columns and "0 steps" in repr(s)
    assert open(s.export_csv(str(tmp_path / "c.csv"))).readline().strip() == ",".join(staff.columns)


def test_generated_script_runs(spark, staff, tmp_path, monkeypatch):
    path = str(tmp_path / "staff.parquet")
    staff.withColumn("label_", F.when(F.col("churn"), "yes").otherwise("no")).drop("churn").write.parquet(path)
    s = Session(spark, path, target="label_")
    code = s.generate_pipeline_code().replace("numFolds=5", "numFolds=2").replace("[5, 10]", "[2]")
    monkeypatch.chdir(tmp_path)
    exec(compile(code.replace("save('model')", f"save('file://{tmp_path}/model')"), "generated", "exec"), {})
    assert (tmp_path / "model").exists()


def test_training(spark, staff, tmp_path):
    got = training.train(staff.withColumn("y", F.col("income") * 2 + F.col("age")), "y", "linear", "regression")
    assert got.metrics["r2"] > 0.99 and got.importances
    got = training.train(staff.withColumn("k", (F.col("age") > 40).cast("string")), "k", "decision_tree")
    assert got.task == "classification" and got.metrics["accuracy"] > 0.95 and got.metrics["confusion"]
    _, m = training.cluster(staff.select("age", "income"), k=3)
    assert len(m["sizes"]) == 3 and m["davies_bouldin"] > 0
    with pytest.raises(ValueError):
        training.train(staff, "income", "no such", "regression")


def test_command_line(spark, staff, tmp_path, capsys):
    path = str(tmp_path / "s.parquet")
    staff.write.parquet(path)
    assert cli.main(["profile", path, "--target", "churn", "--output", str(tmp_path / "p.html")], spark) == 0
    assert cli.main(["drift", path, path, "--cutoff", "2020-06-01", "--output", str(tmp_path / "d")], spark) == 0
    assert json.load(open(tmp_path / "d_drift.json"))["level"] == "Negligible" and (tmp_path / "d_leakage.json").exists()
    assert cli.main(["train", path, "--target", "churn", "--algorithm", "logistic", "--output", str(tmp_path / "m")], spark) == 0
    assert cli.main(["train", path], spark) == 2


def test_entry_without_corpus_operators():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.ORACLE_SQL) > 60


def test_csv_keeps_every_partition_and_quotes(spark, tmp_path):
    import csv

    df = spark.createDataFrame([(1, 'a "b", c'), (2, "two\nlines"), (3, None), (4, "x")], "id int, s string").repartition(3)
    with open(write_csv(df, str(tmp_path / "q.csv")), newline="") as f:
        got = sorted(csv.reader(f, escapechar="\\", doublequote=False))
    assert got == [["1", 'a "b", c'], ["2", "two\nlines"], ["3", ""], ["4", "x"], ["id", "s"]]
    assert open(write_csv(df.where("false"), str(tmp_path / "e.csv"))).read() == "id,s\n"
    assert spark.read.csv(write_csv(df, str(tmp_path / "d"), single=False), header=True).count() >= 4
