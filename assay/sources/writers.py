"""Tables and texts to files."""

from __future__ import annotations

import csv
import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import ident

#: Rows that may go through the driver into one Excel sheet.
EXCEL_ROWS = 1_048_575


def write_text(path: str, text: str) -> str:
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def write_csv(df: DataFrame, path: str, single: bool = True) -> str:
    """One CSV file with a header on the driver's disk, or, for large tables, a folder of files on any file system.

    Executors format the rows; for one file the driver writes them partition by partition, holding one at a time.
    """
    if not single:
        df.write.mode("overwrite").csv(path, header=True)
        return path
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    lines = df.select(F.to_csv(F.struct(*[ident(c).alias(c) for c in df.columns])).alias("line"))
    with open(f"{path}.part", "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerow(df.columns)
        for r in lines.toLocalIterator():
            f.write(r["line"] + "\n")
    os.replace(f"{path}.part", path)
    return path


def write_excel(df: DataFrame, path: str) -> str:
    if df.limit(EXCEL_ROWS + 1).count() > EXCEL_ROWS:
        raise ValueError("more rows than an Excel sheet holds; write CSV or Parquet")
    try:
        df.toPandas().to_excel(path, index=False)
    except ImportError as e:
        raise ImportError("openpyxl is needed to write Excel files") from e
    return os.path.abspath(path)


def write_json(path: str, value) -> str:
    return write_text(path, json.dumps(value, default=str, indent=2))


def embed(value) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(value, default=str).replace("</", "<\\/")


def table_html(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return "<p class='none'>nothing to report</p>"
    columns = columns or list(rows[0])

    def cell(v) -> str:
        return "" if v is None else f"{v:.4g}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)

    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def bars_svg(values: list[tuple[str, float]], width: int = 420, height: int = 120) -> str:
    """A bar chart without scripts."""
    if not values:
        return ""
    top = max(v for _, v in values) or 1.0
    w = width / len(values)
    bars = "".join(f"<rect x='{i * w:.1f}' y='{height - height * v / top:.1f}' width='{max(1.0, w - 1):.1f}' height='{height * v / top:.1f}'><title>{html.escape(str(k))}: {v:g}</title></rect>" for i, (k, v) in enumerate(values))
    return f"<svg viewBox='0 0 {width} {height}' width='{width}' height='{height}' fill='#4878a8'>{bars}</svg>"
