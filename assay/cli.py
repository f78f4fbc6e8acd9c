"""Command line: ``python -m assay.cli profile|drift|train ...``"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from assay.operators import training
from assay.session import Session
from assay.sources.writers import table_html, write_json, write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assay", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("profile", help="profile a table")
    a.add_argument("data")
    a.add_argument("--target")
    a.add_argument("--output", default="profile.html")
    b = sub.add_parser("drift", help="compare a newer table with a reference")
    b.add_argument("ref")
    b.add_argument("new")
    b.add_argument("--target")
    b.add_argument("--cutoff", help="moments after it in the new table count as future data")
    b.add_argument("--threshold", type=float, default=0.85, help="correlation from which a column leaks the target")
    b.add_argument("--output", default="drift")
    c = sub.add_parser("train", help="train and measure a model")
    c.add_argument("data")
    c.add_argument("--target")
    c.add_argument("--algorithm", default="random_forest")
    c.add_argument("--cluster", type=int, help="number of clusters, instead of a target")
    c.add_argument("--folds", type=int, default=0)
    c.add_argument("--tune", action="store_true")
    c.add_argument("--output", default="model")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("assay").getOrCreate()
    if o.command == "profile":
        print(Session(spark, o.data, target=o.target).profile(o.output))
    elif o.command == "drift":
        session = Session(spark, o.ref, target=o.target)
        found = session.drift(o.new, f"{o.output}.html")
        leaks = Session(spark, o.new, target=o.target).leakage_report(threshold=o.threshold, cutoff=o.cutoff)
        print(write_json(f"{o.output}_drift.json", found), write_json(f"{o.output}_leakage.json", leaks), sep="\n")
        print(found["level"], leaks["risk"])
    else:
        df = Session(spark, o.data, target=o.target).get_dataframe()
        if o.cluster:
            model, metrics = training.cluster(df, o.algorithm if o.algorithm in training.CLUSTERINGS else "kmeans", o.cluster)
            rows = []
        else:
            if not o.target:
                print("train needs --target or --cluster", file=sys.stderr)
                return 2
            got = training.train(df, o.target, o.algorithm, folds=o.folds, tune=o.tune)
            model, metrics, rows = got.model, got.metrics, [{"feature": f, "importance": v} for f, v in got.importances]
        model.write().overwrite().save(os.path.abspath(o.output))
        flat = [{"metric": k, "value": v} for k, v in metrics.items()]
        print(write_text(f"{o.output}.html", f"<h1>Model</h1>{table_html(flat)}{table_html(rows)}"))
        print(metrics)
    return 0


if __name__ == "__main__":
    sys.exit(main())
