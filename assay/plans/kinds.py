"""What a column means: numeric, categorical, boolean, datetime, text or nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import ident
from assay.plans.statplan import cardinalities, per_column

TEXT_LENGTH, TEXT_RATIO = 60, 0.85


def type_family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "string" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "nested"


def kinds(df: DataFrame, counted: dict[str, tuple[int, int, int]] | None = None) -> dict[str, str]:
    """Kind per column. A string column is text if its values are long on average or nearly all different.

    counted: (count, distinct values, ...) per column where a frequency table has told already.
    """
    out = {f.name: type_family(f.dataType) for f in df.schema}
    strings = [c for c, k in out.items() if k == "string"]
    if strings:
        lengths = {r["column"]: r["l"] or 0.0 for r in per_column(df, strings, lambda c: {"l": F.avg(F.length(ident(c)))}).collect()}
        counted = counted or {r["column"]: (r["count"], r["n_unique"]) for r in cardinalities(df, strings).collect()}
        for c, (n, unique, *_) in counted.items():
            if c in strings:
                out[c] = "text" if lengths[c] > TEXT_LENGTH or unique / max(1, n) > TEXT_RATIO else "categorical"
        for c in strings:
            if out[c] == "string":
                out[c] = "categorical"
    return out


def drift_kind(kind: T.DataType) -> str:
    """The coarser kinds of drift analysis: booleans are numeric, everything else that isn't a date is categorical."""
    family = type_family(kind)
    return "numeric" if family == "boolean" else family if family in ("numeric", "datetime") else "categorical"


def interaction_kind(kind: T.DataType) -> str:
    """The kinds of pairwise association: booleans are categorical and there is no text."""
    family = type_family(kind)
    return family if family in ("numeric", "datetime") else "categorical"


def of_kind(found: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, k in found.items() if k in wanted]
